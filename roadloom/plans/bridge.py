"""A deterministic road network and traces out of the driver's tables, in arithmetic that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.operators.network import Network

COLUMNS = 40
#: Events until a trip turns back, within its row.
TURN = 80
CLASSES = (1, 3, 5, 7, 9, 10, 10, 50)
CLASS_NAMES = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "service")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("node_id"), (F.lit(-118.30) + F.lit(0.002) * (i % COLUMNS)).alias("lon"), (F.lit(33.90) + F.lit(0.0015) * F.floor(i / COLUMNS)).alias("lat")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    weight = F.element_at(F.array(*(F.lit(c) for c in CLASSES)), (F.col("p_size") % 8 + 1).cast("int"))
    i = F.col("k")
    ways = part.select("k", "p_size", weight.alias("weight"), F.explode(F.array(F.struct((F.col("k") + 1).alias("to"), (i * 2).alias("way_id"), F.lit(True).alias("east")), F.struct((F.col("k") + COLUMNS).alias("to"), (i * 2 + 1).alias("way_id"), F.lit(False).alias("east")))).alias("e"))
    ways = ways.select("k", "p_size", "weight", "e.*").where(~F.col("east") | (i % COLUMNS != COLUMNS - 1))
    ways = ways.join(part.select(F.col("k").alias("to")), "to")
    ahead = F.struct(F.col("k").alias("source"), F.col("to").alias("target"))
    back = F.struct(F.col("to").alias("source"), F.col("k").alias("target"))
    out = ways.select(F.explode(F.when(F.col("p_size") % 7 == 0, F.array(ahead)).otherwise(F.array(ahead, back))).alias("x"), "weight", "way_id").select("x.source", "x.target", "weight", "way_id", F.lit("Outgoing").alias("direction"))
    # part is one small file: without this, one task would work through all that is joined to its roads
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source")


def network(spark: SparkSession, sf_dir: str) -> Network:
    return Network(nodes(spark, sf_dir), edges(spark, sf_dir))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trip for each user along a row of nodes, of all the user's events; it turns back before the row's end."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = F.floor((read(spark, sf_dir, "part").count() - 1) / F.lit(COLUMNS)) + 1
    ev = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").withColumn("k", k)
    k = F.pmod(F.col("k"), F.lit(2 * TURN))
    step = F.least(k, 2 * TURN - k)
    lat = F.lit(33.90) + F.lit(0.0015) * (F.col("user_id") % rows) + F.lit(0.00003) * (F.floor(F.col("value") * 100) % 7 - 3)
    return ev.select(F.col("user_id").alias("trip"), F.col("k").cast("int").alias("layer"), "ts", (F.lit(-118.30) + F.lit(0.002) * (F.lit(0.3) + F.lit(0.45) * step)).alias("lon"), lat.alias("lat"))


# The same in SQL.
NODES_SQL = f"nodes as (select p_partkey as node_id, -118.30::double + 0.002::double * (p_partkey % {COLUMNS}) as lon, 33.90::double + 0.0015::double * (p_partkey // {COLUMNS}) as lat from part)"
EDGES_SQL = f"""ways as (
  select p_partkey as k, p_size, [{', '.join(map(str, CLASSES))}][p_size % 8 + 1] as weight, p_partkey + 1 as nxt, p_partkey * 2 as way_id from part where p_partkey % {COLUMNS} <> {COLUMNS - 1}
  union all select p_partkey, p_size, [{', '.join(map(str, CLASSES))}][p_size % 8 + 1], p_partkey + {COLUMNS}, p_partkey * 2 + 1 from part),
real_ways as (select * from ways where nxt in (select p_partkey from part)),
edges as (select k as source, nxt as target, weight, way_id from real_ways union all select nxt, k, weight, way_id from real_ways where p_size % 7 <> 0)"""
TRACES_SQL = f"""steps as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events),
traces as (select user_id as trip, k as layer, ts, -118.30::double + 0.002::double * (0.3::double + 0.45::double * least(k % {2 * TURN}, {2 * TURN} - k % {2 * TURN})) as lon,
  33.90::double + 0.0015::double * (user_id % (select (count(*) - 1) // {COLUMNS} + 1 from part)) + 0.00003::double * (floor(value * 100)::bigint % 7 - 3) as lat from steps)"""
FAT_SQL = "fat as (select e.*, a.lon as lon1, a.lat as lat1, b.lon as lon2, b.lat as lat2 from edges e join nodes a on a.node_id = e.source join nodes b on b.node_id = e.target)"
BASE_SQL = f"with {NODES_SQL}, {EDGES_SQL}, {TRACES_SQL}, {FAT_SQL}"


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = f"(sin((radians({lat2})-radians({lat1}))/2)*sin((radians({lat2})-radians({lat1}))/2)+cos(radians({lat1}))*cos(radians({lat2}))*sin(radians(({lon2})-({lon1}))/2)*sin(radians(({lon2})-({lon1}))/2))"
    return f"(2*6371008.8*asin(sqrt(least(1.0,{h}))))"


def sql_bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    d = f"radians(({lon2})-({lon1}))"
    raw = f"degrees(atan2(sin({d})*cos(radians({lat2})),cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))*cos({d})))"
    return f"(case when {raw} < 0 then {raw} + 360 else {raw} end)"


_E2 = "(1/298.257223563*(2-1/298.257223563))"


def sql_half_box(lat: str, distance: float) -> tuple[str, str]:
    side, w = f"degrees({distance}/sqrt(2))", f"(1-{_E2}*sin(radians({lat}))*sin(radians({lat})))"
    return f"({side}*sqrt({w})/(6378137.0*cos(radians({lat}))))", f"({side}*{w}*sqrt({w})/(6378137.0*(1-{_E2})))"


_HX, _HY = sql_half_box("t.lat", 50)
_D = sql_haversine("lon1", "lat1", "lon2", "lat2")
#: Candidates of the traces, as SQL after BASE_SQL.
CANDIDATES_SQL = f"""near as (select t.trip, t.layer, t.lon, t.lat, f.* from traces t join fat f on least(lon1,lon2) <= t.lon + {_HX} and greatest(lon1,lon2) >= t.lon - {_HX} and least(lat1,lat2) <= t.lat + {_HY} and greatest(lat1,lat2) >= t.lat - {_HY}),
proj as (select *, greatest(0.0, least(1.0, ((lon-lon1)*(lon2-lon1)+(lat-lat1)*(lat2-lat1))/((lon2-lon1)*(lon2-lon1)+(lat2-lat1)*(lat2-lat1)))) as fraction, {_D}/6371008.8 as d from near),
part_ as (select *, sin((1-fraction)*d)/sin(d) as p, sin(fraction*d)/sin(d) as q from proj),
xyz as (select *, p*cos(radians(lat1))*cos(radians(lon1))+q*cos(radians(lat2))*cos(radians(lon2)) as x, p*cos(radians(lat1))*sin(radians(lon1))+q*cos(radians(lat2))*sin(radians(lon2)) as y, p*sin(radians(lat1))+q*sin(radians(lat2)) as z from part_),
placed as (select *, case when fraction = 0 then lon1 when fraction = 1 then lon2 else degrees(atan2(y, x)) end as px, case when fraction = 0 then lat1 when fraction = 1 then lat2 else degrees(atan2(z, sqrt(x*x+y*y))) end as py from xyz),
candidates as (select *, floor(round(100.0 / greatest(1e-6, least(1.0, exp(-sqrt(metres/25.0)))), 9))::bigint as emission, row_number() over (partition by trip, layer order by source, target) - 1 as node
  from (select *, {sql_haversine('lon', 'lat', 'px', 'py')} as metres from placed))"""
