"""Candidates, costs and map matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import costing, matching, solving, spatial
from roadloom.operators.tables import written
from roadloom.plans import bridge as B
from roadloom.plans.registry import query

BASE = f"{B.BASE_SQL}, {B.CANDIDATES_SQL}"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return spatial.candidates(B.traces(spark, d).select("trip", "layer", "lon", "lat"), B.network(spark, d).fat_edges())


@query(f"{BASE} select trip, layer, node, source, target, way_id, round(px, 6) as lon, round(py, 6) as lat, round(fraction, 6) as fraction, emission from candidates")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("trip", F.col("layer").cast("long").alias("layer"), F.col("node").cast("long").alias("node"), "source", "target", "way_id", F.round("px", 6).alias("lon"), F.round("py", 6).alias("lat"), F.round("fraction", 6).alias("fraction"), "emission")


@query(f"{BASE} select trip, layer, source, target, round(metres, 3) as metres from (select *, row_number() over (partition by trip, layer order by source, target) as r from (select *, min(metres) over (partition by trip, layer) as nearest from candidates) where metres <= nearest + 1e-6) where r = 1")
def nearest_projected(spark: SparkSession, d: str) -> DataFrame:
    points = B.traces(spark, d).select(F.struct("trip", "layer").alias("k"), "lon", "lat")
    rows = spatial.nearest_projected(points, B.network(spark, d).fat_edges(), "k", 50.0)
    return rows.select("k.trip", F.col("k.layer").cast("long").alias("layer"), "source", "target", F.round("metres", 3).alias("metres"))


@query("select o_orderkey as k, floor(round(100.0 / greatest(1e-6, least(1.0, exp(-sqrt((o_totalprice % 60) / 25.0)))), 9))::bigint as cost from orders")
def emission_cost(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), spatial.emission_cost(F.col("o_totalprice") % 60).alias("cost"))


_SCORE = "sqrt(greatest(1e-6, least(1.0, l_discount * 10)) * greatest(1e-6, least(1.0, l_tax * 12)) * greatest(1e-6, least(1.0, least(1.0, (l_orderkey % 10 + 1)::double / (l_partkey % 10 + 1)))))"


@query(f"select l_orderkey as k, l_linenumber as n, least(floor(round(100.0 / greatest(1e-6, least(1.0, {_SCORE})), 9)), 1073741823)::bigint as cost from lineitem")
def transition_cost(spark: SparkSession, d: str) -> DataFrame:
    score = costing.transition_score(F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_orderkey") % 10 + 1, F.col("l_partkey") % 10 + 1)
    return B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), costing.score_cost(score).alias("cost"))


_STRAIGHT = B.sql_haversine("a.px", "a.py", "b.px", "b.py")


@query(f"{BASE} select a.trip, a.layer, a.node as a_node, b.node as b_node, round({_STRAIGHT}, 4) as straight from candidates a join candidates b on b.trip = a.trip and b.layer = a.layer + 1")
def layer_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = spatial.layer_pairs(_candidates(spark, d))
    return rows.select("trip", F.col("layer").cast("long").alias("layer"), F.col("a_node").cast("long").alias("a_node"), F.col("b_node").cast("long").alias("b_node"), F.round("straight", 4).alias("straight"))


@query(f"{BASE} select trip, layer, a_node, b_node from (select a.trip, a.layer, a.node as a_node, b.node as b_node, row_number() over (partition by a.trip, a.layer, a.node order by round({_STRAIGHT}, 6), b.node) as r from candidates a join candidates b on b.trip = a.trip and b.layer = a.layer + 1) where r <= 2")
def layer_pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    return solving.nearest_pairs(written(_candidates(spark, d).select("trip", "layer", "node", "px", "py")), 2)


def _matched(spark: SparkSession, d: str, solver: str = "fastest") -> matching.Matched:
    return matching.match(B.traces(spark, d), B.network(spark, d), matching.Options(solver=solver))


@query()
def match_discretized(spark: SparkSession, d: str) -> DataFrame:
    return matching.discretized(_matched(spark, d))


@query()
def match_interpolated(spark: SparkSession, d: str) -> DataFrame:
    return matching.interpolated(_matched(spark, d))


@query()
def match_status(spark: SparkSession, d: str) -> DataFrame:
    return matching.status(_matched(spark, d))


@query()
def match_selective(spark: SparkSession, d: str) -> DataFrame:
    return matching.discretized(_matched(spark, d, "selective"))


@query()
def hop_lengths(spark: SparkSession, d: str) -> DataFrame:
    hops = matching.hop_figures(_candidates(spark, d), B.network(spark, d), matching.Options())
    return hops.select("trip", "layer", "a_node", "b_node", "method", F.round("route", 3).alias("route"), F.round("straight", 3).alias("straight"), F.round("turns", 6).alias("turns"), "cost")


@query(f"{BASE} select trip, layer, source as edge_source, target as edge_target, round(px, 6) as lon, round(py, 6) as lat from (select *, row_number() over (partition by trip, layer order by source, target) as r from (select *, min(metres) over (partition by trip, layer) as nearest from candidates) where metres <= nearest + 1e-6) where r = 1")
def snap(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.snap(B.traces(spark, d), B.network(spark, d))
    return rows.select("trip", F.col("layer").cast("long").alias("layer"), "edge_source", "edge_target", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("layer", "lon", "lat")
    rows = B.traces(spark, d).groupBy("trip").agg(F.sort_array(F.collect_list(at)).alias("p"))
    return rows.select("trip", F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


_STEP = B.sql_haversine("lon", "lat", "nlon", "nlat")
_TURN = B.sql_bearing("lon", "lat", "nlon", "nlat")
_HEADS = f"""{B.BASE_SQL}, s as (select trip, layer, lon, lat, lead(lon) over w as nlon, lead(lat) over w as nlat, count(*) over (partition by trip) as n from traces window w as (partition by trip order by layer)),
h as (select trip, layer, n, {_STEP} as metres, {_TURN} as heading from s where nlon is not null), far as (select * from h where metres >= 1),
t as (select trip, n, heading, lead(heading) over (partition by trip order by layer) as nxt from far),
turns as (select trip, n, 180.0 - (((180.0 - (nxt - heading)) % 360.0) + 360.0) % 360.0 as turn from t where nxt is not null)"""


@query(f"{_HEADS} select s.trip, round(coalesce(sum(metres), 0), 6) as length from (select distinct trip from s) s left join h using (trip) group by s.trip")
def path_length(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("trip", F.round(costing.length(F.col("points")), 6).alias("length"))


@query(f"{_HEADS} select s.trip, round(coalesce(sum(abs(turn)), 0), 6) as total, round(coalesce(sum(abs(turn)), 0) / max(s.n), 6) as immediate from (select distinct trip, n from s) s left join turns using (trip) group by s.trip")
def path_angles(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("points")
    return _lines(spark, d).select("trip", F.round(costing.total_angle(p), 6).alias("total"), F.round(costing.immediate_angle(p), 6).alias("immediate"))


@query(f"""{_HEADS}, e as (select trip, greatest(0.0, least(1.0, cos(turn * pi() / 180.0 * 0.8))) as ease from turns)
select s.trip, round(case when count(ease) = 0 then 1.0 when min(ease) <= 0 then 0.0 else count(ease) / sum(case when ease > 0 then 1.0 / ease end) end, 6) as complexity from (select distinct trip from s) s left join e using (trip) group by s.trip""")
def path_complexity(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("trip", F.round(costing.complexity(F.col("points")), 6).alias("complexity"))
