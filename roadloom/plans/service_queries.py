"""Lookups, ranges, quadtrees, texts and what services answer with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import cells, geo, tags, texts
from roadloom.operators import clusters, history, spatial, tiles, timezones, trellis
from roadloom.plans import bridge as B
from roadloom.plans import graph_queries, match_queries
from roadloom.plans.registry import query

BASE = B.BASE_SQL
_QUAD = f"""q as (select node_id, floor((lon + 180) / 360 * 64)::bigint as x, floor((lat + 90) / 180 * 64)::bigint as y from (select node_id, -180 + (node_id * 37 % 3600) / 10.0 as lon, -90 + (node_id * 53 % 1800) / 10.0 as lat from nodes))"""


def _key(x: str, y: str) -> str:
    return "(" + " + ".join(f"((((({x}) >> {5 - k}) & 1) + 2 * ((({y}) >> {5 - k}) & 1)) << {2 * k})" for k in range(6)) + ")"


def _spread(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("node_id")
    return B.nodes(spark, d).select("node_id", cells.quadkey(F.lit(-180) + (k * 37 % 3600) / F.lit(10.0), F.lit(-90) + (k * 53 % 1800) / F.lit(10.0), 6).alias("key"))


@query(f"{BASE}, {_QUAD} select node_id, {_key('x', 'y')}::bigint as key, x * 5.625 - 180 as west, y * 2.8125 - 90 as south, (x + 1) * 5.625 - 180 as east, (y + 1) * 2.8125 - 90 as north from q".replace("5.625", "5.625::double").replace("2.8125", "2.8125::double"))
def quadtree_bounds(spark: SparkSession, d: str) -> DataFrame:
    box = cells.quadkey_bounds(F.col("key"), 6)
    return _spread(spark, d).select("node_id", "key", *(b.alias(n) for b, n in zip(box, ("west", "south", "east", "north"), strict=True)))


@query(f"{BASE}, {_QUAD}, o as (select * from (values (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)) t(dx, dy)) select node_id, {_key('x + dx', 'y + dy')}::bigint as near from q, o where x + dx between 0 and 63 and y + dy between 0 and 63")
def quadtree_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _spread(spark, d).select("node_id", F.explode(cells.quadkey_neighbours(F.col("key"), 6)).alias("near"))


@query(f"{BASE}, p as (select user_id, 1 + event_id % (select count(*) from part) as a, 1 + event_id % (select count(*) from part) + 1 as b from events) select user_id as key, source, target, weight, way_id from p join edges on source = a and target = b")
def edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.lit(1) + F.col("event_id") % B.read(spark, d, "part").count()
    pairs = B.read(spark, d, "events").select(F.col("user_id").alias("key"), k.alias("source"), (k + 1).alias("target"))
    return B.network(spark, d).edge_between(pairs).select("key", "source", "target", "weight", "way_id")


@query(f"{BASE} select source, target, weight, way_id, 'Outgoing' as direction from fat")
def edge_thin(spark: SparkSession, d: str) -> DataFrame:
    n = B.network(spark, d)
    return n.thin_edges(n.fat_edges())


@query(f"{BASE} select source, target, way_id, round({B.sql_haversine('lon1', 'lat1', 'lon2', 'lat2')}, 6) as metres, (way_id % 4)::int as lane_count, (way_id % 10 * 10)::int as speed_kmh from fat")
def edge_details(spark: SparkSession, d: str) -> DataFrame:
    n = B.network(spark, d)
    n.way_meta = n.edges.select("way_id").distinct().select("way_id", (F.col("way_id") % 4).cast("int").alias("lane_count"), (F.col("way_id") % 10 * 10).cast("int").alias("speed_kmh"))
    return n.edge_details(n.edges).select("source", "target", "way_id", F.round("metres", 6).alias("metres"), "lane_count", "speed_kmh")


@query(f"{BASE}, {B.CANDIDATES_SQL}, k as (select node_id from nodes where node_id % 40 < 38) select trip, bool_and(source in (select node_id from k) and target in (select node_id from k)) as supported from candidates group by trip")
def trip_supported(spark: SparkSession, d: str) -> DataFrame:
    """Whether a network without its easternmost columns knows every candidate of each trip."""
    n = B.network(spark, d)
    n.nodes = n.nodes.where("node_id % 40 < 38")
    return n.supports(match_queries._candidates(spark, d))


@query(f"{BASE}, {B.CANDIDATES_SQL}, o as (select *, row_number() over (partition by trip, layer order by emission, node) - 1 as place from candidates) select trip, layer, node, place, node = 0 as chosen from o")
def display_order(spark: SparkSession, d: str) -> DataFrame:
    cand = match_queries._candidates(spark, d)
    rows = spatial.display_order(cand, cand.where("node = 0"))
    return rows.select("trip", F.col("layer").cast("long").alias("layer"), F.col("node").cast("long").alias("node"), F.col("place").cast("long").alias("place"), "chosen")


@query("select o_orderkey as k, case when o_orderkey % 6 = 0 then 'forward' when o_orderkey % 6 = 1 then 'backward' when o_orderkey % 6 = 2 then 'both_ways' when o_orderkey % 6 = 3 then 'left' when o_orderkey % 6 = 4 then 'right' else 'both' end as direction, o_orderkey % 6 < 3 as along, o_orderkey % 6 >= 3 as side, case o_orderkey % 6 when 0 then 'backward' when 1 then 'forward' when 3 then 'right' when 4 then 'left' end as opposite from orders")
def direction_predicates(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("forward", "backward", "both_ways", "left", "right", "both")))
    rows = B.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("direction"))
    c = F.col("direction")
    return rows.select("k", "direction", tags.is_directional(c).alias("along"), tags.is_positional(c).alias("side"), tags.opposite(c).alias("opposite"))


@query("select o_orderkey as k, case o_orderkey % 3 when 0 then 'motor_vehicle' when 1 then 'bus' else 'hgv' end as mode, case when o_orderkey % 5 > 0 then (o_orderkey % 5)::double end as height, case when o_orderkey % 4 > 0 then (o_orderkey % 4)::double end as weight from orders")
def trip_runtime(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.lit(None).cast("double")
    kind = F.element_at(F.array(F.lit("car"), F.lit("bus"), F.lit("truck")), (k % 3 + 1).cast("int"))
    vehicle = F.struct(kind.alias("kind"), F.when(k % 5 > 0, (k % 5).cast("double")).alias("height"), none.alias("width"), F.when(k % 4 > 0, (k % 4).cast("double")).alias("weight"), none.alias("axle_load"), none.alias("length"))
    rows = B.read(spark, d, "orders").select(k.alias("k"), tags.runtime(vehicle).alias("r"))
    return rows.select("k", "r.mode", F.try_element_at("r.properties", F.lit("height")).alias("height"), F.try_element_at("r.properties", F.lit("weight")).alias("weight"))


@query("select l_orderkey as k, l_linenumber as n, case when u < 1000 then u || ' µs' when u < 1000000 then printf('%.2f ms', u / 1000.0) else printf('%.3f s', u / 1000000.0) end as took, format('{:,}', u) || ' pts/s' as rate from (select l_orderkey, l_linenumber, (l_orderkey * 7919 % 100 * pow(10, l_partkey % 6))::bigint as u from lineitem)")
def readable_figures(spark: SparkSession, d: str) -> DataFrame:
    u = (F.col("l_orderkey") * 7919 % 100 * F.pow(F.lit(10), F.col("l_partkey") % 6)).cast("long")
    return B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), texts.duration(u).alias("took"), texts.throughput(u.cast("double")).alias("rate"))


@query(f"with {graph_queries._TRELLIS} select trip, layer - 1 as layer, f as \"from\", t as \"to\", weight from te where layer between 1 and 2")
def layer_partition(spark: SparkSession, d: str) -> DataFrame:
    edges = trellis.partition(graph_queries._trellis(spark, d)[1], 1, 4, boundaries=True)
    return edges.select("trip", F.col("layer").cast("long").alias("layer"), "from", "to", "weight")


@query("select event_id as seq, (epoch(ts) - (select min(epoch(ts)) from events)) / 60.0 as due from events")
def replay_pacing(spark: SparkSession, d: str) -> DataFrame:
    return history.paced(B.read(spark, d, "events"), 60.0).select(F.col("event_id").alias("seq"), "due")


@query("select o_orderkey as k, o_orderstatus = 'F' as matched, o_orderstatus not in ('F', 'O') as fatal from orders")
def outcome_classes(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "solved").when(F.col("o_orderstatus") == "O", "disconnected").otherwise("broken")
    return B.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), history.outcome(status).alias("o")).select("k", "o.matched", "o.fatal")


@query("select s_suppkey as a, t.s_suppkey as b from supplier s join (select s_suppkey, s_nationkey * 1.0 as x, s_suppkey % 13 * 1.0 as y from supplier) t on greatest(abs(s.s_nationkey - t.x), abs(s.s_suppkey % 13 - t.y)) < 2".replace("select s_suppkey as a", "select s.s_suppkey as a"))
def cluster_distance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points that are near by a distance of one's own: the larger of the differences."""
    points = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_suppkey") % 13).cast("double").alias("y"))
    return clusters.neighbours(points, 2.0, lambda ax, ay, bx, by: F.greatest(F.abs(ax - bx), F.abs(ay - by)))


@query()
def geodesic_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of edges on the ellipsoid; a test has known ones."""
    return B.network(spark, d).fat_edges().select("source", "target", F.round(geo.geodesic("lon1", "lat1", "lon2", "lat2"), 6).alias("metres"))


@query("""select o_orderkey % 4 as x, o_orderkey % 3 as y, count(*) as n from orders where strftime(o_orderdate, '%y%m%d') between '960101' and '961231' group by 1, 2""")
def tile_key_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a year, found by the key ranges of four by three tiles, each with finer tiles below it."""
    k = F.col("o_orderkey")
    fine_x, fine_y = (k % 4) * 2 + k % 2, (k % 3) * 2
    rows = B.read(spark, d, "orders").select((k % 4).alias("x"), (k % 3).alias("y"), tiles.row_key(fine_x, fine_y, 10, F.col("o_orderdate")).alias("row_key"), k.alias("id"))
    ranges = tiles.row_ranges(rows.select("x", "y").distinct(), 9, 10, "1996-01-01", "1996-12-31")
    return tiles.in_ranges(rows, ranges).groupBy("x", "y").agg(F.count("*").alias("n"))


@query()
def zone_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of some zones; a test has known ones."""
    names = ("Australia/Sydney", "America/Chicago", "Europe/Zurich", "Asia/Kolkata", "UTC")
    rows = B.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("n_nationkey") % len(names) + 1).cast("int")).alias("tzid"))
    return rows.select("k", "tzid", timezones.primary_offset(F.col("tzid")).alias("o")).select("k", "tzid", "o.seconds", "o.minutes", "o.hours")
