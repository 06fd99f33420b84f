"""Lookups and figures whose right answers are known."""

import pytest
from pyspark.sql import functions as F

from roadloom.functions import cells, geo
from roadloom.operators import history, placement, timezones, trellis


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_geodesic_lengths(spark):
    quarter = one(spark, geo.geodesic(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert abs(quarter - 10_001_965.729) < 0.01  # a quarter of a meridian of WGS84
    degree = one(spark, geo.geodesic(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert abs(degree - 111_319.4908) < 0.001  # a degree of its equator
    assert one(spark, geo.geodesic(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0))) == 0.0
    assert one(spark, geo.geodesic(F.lit(0.0), F.lit(0.0), F.lit(179.9), F.lit(0.1))) is None


def test_primary_offsets(spark):
    found = {z: tuple(one(spark, timezones.primary_offset(F.lit(z)))) for z in ("Australia/Sydney", "America/Chicago", "Asia/Kolkata")}
    assert found == {"Australia/Sydney": (36000, 600, 10), "America/Chicago": (-21600, -360, -6), "Asia/Kolkata": (19800, 330, 5)}


def test_quadtree_round_trip(spark):
    rows = spark.createDataFrame([(12.3, -45.6), (-180.0, 90.0), (179.99, -89.9)], "lon double, lat double").withColumn("k", cells.quadkey("lon", "lat", 9))
    west, south, east, north = cells.quadkey_bounds(F.col("k"), 9)
    assert rows.where((F.col("lon") >= west) & (F.col("lon") <= east) & (F.col("lat") >= south) & (F.col("lat") <= north)).count() == 3
    assert [len(r["n"]) for r in rows.select(cells.quadkey_neighbours(F.col("k"), 9).alias("n")).collect()] == [8, 3, 3]


@pytest.mark.parametrize(("text", "want"), [("5-9", (5, 9)), (" 7 ", (7, 7)), ("0-1023", (0, 1023)), ("9-5", None), ("0-1024", None), ("x", None)])
def test_partition_ranges(text, want):
    if want is None:
        with pytest.raises(ValueError):
            placement.parsed_range(text)
    else:
        assert placement.parsed_range(text) == want


def test_slices_cover_all_partitions(spark):
    for fleet in (1, 3, 7, 16):
        rows = spark.range(fleet).select(*placement.fleet_slice(F.col("id"), F.lit(fleet))).toDF("a", "b").collect()
        assert sorted(p for r in rows for p in range(r["a"], r["b"] + 1)) == list(range(1024))


def test_layers_are_cut_and_appended(spark):
    nodes = spark.createDataFrame([(1, k, n, 1) for k in range(4) for n in range(2)], "trip bigint, layer int, node int, weight bigint")
    edges = spark.createDataFrame([(1, k, a, b, 3 + a + 2 * b) for k in range(3) for a in range(2) for b in range(2)], "trip bigint, layer int, `from` int, `to` int, weight bigint")
    n, e = trellis.partition(nodes, 0, 3), trellis.partition(edges, 0, 3, boundaries=True)
    assert n.count() == 6 and e.count() == 8
    short, whole = trellis.viterbi(n, e), trellis.viterbi(nodes, edges)
    last = trellis.appended(short, edges, nodes).first()
    assert (last["layer"], last["node"], last["cost"]) == (3, 0, whole.first()["cost"])
    with pytest.raises(ValueError):
        trellis.partition(nodes, 2, 2)


def test_messages_are_sorted_out(spark):
    fine, odd = history.sorted_out(spark.createDataFrame([("1", 1), ("x", None)], "raw string, parsed int"), "parsed")
    assert [r["raw"] for r in fine.collect()] == ["1"] and [r["raw"] for r in odd.collect()] == ["x"]
