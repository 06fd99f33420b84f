import math
import struct
import zlib

from pyspark.sql import functions as F

from roadloom.functions import cells, geo, hashing, hours, tags
from roadloom.operators import clusters, costing
from roadloom.sources import pbf


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def points(*xy):
    return F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in xy))


def test_hashes(spark):
    rows = spark.createDataFrame([("",), ("a",), ("vehicle-42",)], "t string").select(hashing.fnv1a64(F.col("t")).alias("h")).collect()
    assert [r["h"] & hashing.MASK for r in rows] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0xF4DCEA256EDE2C6C]
    ids = spark.createDataFrame([(0,), (1,), (0xDEADBEEF,), (-1,)], "v bigint")
    got = ids.select(hashing.mix64(F.col("v")).alias("m"), hashing.vehicle_partition(F.col("v")).alias("p")).collect()
    assert [r["m"] & hashing.MASK for r in got] == [0, 0x5692161D100B05E5, 0x4E062702EC929EEA, 0xB4D055FCF2CBBD7B]
    assert [r["p"] for r in got][1:] == [485, 746, 379]


def test_cells(spark):
    assert one(spark, cells.geohash(-5.6, 42.6, 5)) == "ezs42"
    assert [one(spark, cells.quadkey(x, y, 1)) for x, y in ((-90, -45), (90, -45), (-90, 45), (90, 45))] == [0, 1, 2, 3]
    assert one(spark, cells.quadkey(1000, 1000, 6)) == one(spark, cells.quadkey(180, 90, 6))
    seen = {one(spark, cells.hilbert(F.lit(x), F.lit(y), 2)) for x in range(4) for y in range(4)}
    assert seen == set(range(16))


def test_path_shapes(spark):
    assert abs(one(spark, costing.total_angle(points((0, 0), (0, 1), (1, 1)))) - 90) < 1
    bend = ((8.0, 50.0), (8.004, 50.001), (8.008, 50.0035))

    def heading(a, b):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
        return math.degrees(math.atan2(math.sin(x2 - x1) * math.cos(y2), math.cos(y1) * math.sin(y2) - math.sin(y1) * math.cos(y2) * math.cos(x2 - x1)))

    turn = abs(heading(*bend[1:]) - heading(*bend[:2]))
    assert 10 < turn < 30 and abs(one(spark, costing.total_angle(points(*bend))) - turn) < 1e-6
    assert abs(one(spark, costing.immediate_angle(points(*bend))) - turn / 3) < 1e-6
    assert abs(one(spark, costing.complexity(points(*bend))) - math.cos(math.radians(turn * 0.8))) < 1e-6
    assert one(spark, costing.complexity(points((0, 0), (0, 1)))) == 1.0
    assert one(spark, costing.complexity(points((0, 0), (0, 1), (0, 0.5)))) == 0.0


def test_emission_values(spark):
    from roadloom.operators.spatial import emission_cost

    assert [one(spark, emission_cost(F.lit(float(d)))) for d in (0, 5, 10, 25, 50)] == [100, 156, 188, 271, 411]
    assert one(spark, costing.score_cost(F.lit(None).cast("double"))) == 0


def test_half_box(spark):
    x, y = geo.half_box(F.lit(0.0), 50.0)
    assert abs(one(spark, y) * 110574.3 - 50 / math.sqrt(2)) < 0.01 and abs(one(spark, x) * 111319.5 - 50 / math.sqrt(2)) < 0.01


def test_speeds_and_lanes(spark):
    values = ("50", "20 mph", "10 knots", "none", "walk", "0", "70 kph")
    assert [one(spark, tags.speed_kmh(F.lit(v))) for v in values] == [50, 32, 18, None, None, None, 70]
    assert one(spark, tags.lanes(F.lit("100|80||50"))) == ["100", "80", None, "50"]
    assert one(spark, tags.lanes(F.lit("|50"))) == [None, "50"]
    tag = F.create_map(F.lit("maxspeed:bus:backward"), F.lit("70"), F.lit("maxspeed:lanes"), F.lit("65 mph|25 mph"), F.lit("maxspeed:conditional"), F.lit("130 @ (19:00-06:00)"))
    found = {r["key"]: r for r in one(spark, tags.speed_limits(tag))}
    assert (found["maxspeed:bus:backward"]["mode"], found["maxspeed:bus:backward"]["direction"]) == ("bus", "backward")
    assert found["maxspeed:lanes"]["speeds"] == [104, 40]
    assert found["maxspeed:conditional"]["conditions"] == ["(19:00-06:00)"]


def test_modes_and_access(spark):
    assert tags.mode_chain("hgv") == ["access", "vehicle", "motor_vehicle", "goods", "hgv"]
    assert len(tags.ROAD_WEIGHTS) == 21
    rules = tags.access_rules(F.create_map(F.lit("access"), F.lit("no"), F.lit("motor_vehicle"), F.lit("destination"), F.lit("motorcar"), F.lit("yes"), F.lit("name"), F.lit("no")))
    assert one(spark, tags.accessible(rules, "motorcar")) and not one(spark, tags.accessible(rules, "bicycle")) and not one(spark, tags.accessible(rules, "bus"))
    assert one(spark, tags.accessible(F.array().cast("array<struct<mode:string,direction:string,access:string>>"), "foot"))


def test_hours_and_conditions(spark):
    assert [len(hours.parse_hours(t)) for t in ("24/7", "09:00-17:00", "Mo-Fr 09:00-17:00; Sa 10:00-14:00", "closed")] == [1, 1, 2, 1]
    assert hours.parse_hours("nonsense") is None
    assert hours.parse_condition("weight < 7.5")["number"] == 7.5
    assert hours.parse_condition("winter")["kind"] == "season"
    assert hours.parse_condition("Tu-Fr 00:00-24:00")["kind"] == "time"
    assert hours.parse_condition("(weight > 3 AND wet)")["kind"] == "and"


def test_wkt(spark):
    assert [tuple(p) for p in one(spark, geo.from_wkt(F.lit("LINESTRING (1 2, 3.5 -4)")))] == [(1.0, 2.0), (3.5, -4.0)]


def test_hull():
    ring = clusters.convex_hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])
    assert sorted(ring) == [(0, 0), (0, 2), (2, 0), (2, 2)] and clusters.centroid(ring) == (1.0, 1.0)


def _v(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def _f(number, value):
    return _v(number << 3) + _v(value) if isinstance(value, int) else _v(number << 3 | 2) + _v(len(value)) + value


def _z(values):
    out, last = b"", 0
    for v in values:
        d, last = v - last, v
        out += _v((d << 1) ^ (d >> 63))
    return out


def pbf_bytes():
    strings = [b"", b"highway", b"primary", b"oneway", b"yes", b"outer"]
    table = b"".join(_f(1, s) for s in strings)
    dense = _f(1, _z([1, 2, 3])) + _f(8, _z([341500000, 341500000, 341600000])) + _f(9, _z([-1181500000, -1181600000, -1181700000]))
    node = _f(1, 18) + _f(8, 20) + _f(9, 40)
    way = _f(1, 7) + _f(2, _v(1) + _v(3)) + _f(3, _v(2) + _v(4)) + _f(8, _z([1, 2, 3]))
    relation = _f(1, 5) + _f(8, _v(5)) + _f(9, _z([7])) + _f(10, _v(1))
    block = _f(1, table) + _f(2, _f(2, dense) + _f(1, node)) + _f(2, _f(3, way) + _f(4, relation))
    out = b""
    for kind, body in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = _f(2, len(body)) + _f(3, zlib.compress(body))
        head = _f(1, kind) + _f(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    return out


def test_pbf_source(spark, tmp_path):
    path = tmp_path / "a.osm.pbf"
    path.write_bytes(pbf_bytes())
    network = pbf.ingest(spark, str(path), str(tmp_path / "saved"))
    nodes = {r["node_id"]: (round(r["lon"], 7), round(r["lat"], 7)) for r in network.nodes.collect()}
    assert nodes == {1: (-118.15, 34.15), 2: (-118.16, 34.15), 3: (-118.17, 34.16), 9: (2e-06, 1e-06)}
    assert sorted((r["source"], r["target"], r["weight"], r["way_id"]) for r in network.edges.collect()) == [(1, 2, 5, 7), (2, 3, 5, 7)]
    relations = spark.read.format("osmpbf").option("path", str(path)).option("kind", "relations").load().collect()
    assert relations[0]["members"][0]["role"] == "outer"
