"""Networks, adjacency, searches and trellises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import tags
from roadloom.operators import network as N
from roadloom.operators import reach, spatial, trellis
from roadloom.plans import bridge as B
from roadloom.plans.registry import query

BASE = B.BASE_SQL


@query(f"{BASE} select * from nodes")
def network_nodes(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d)


@query(f"{BASE} select source, target, weight, way_id from edges")
def network_edges(spark: SparkSession, d: str) -> DataFrame:
    return B.edges(spark, d).drop("direction")


@query(f"{BASE} select (select count(*) from nodes) as num_nodes, (select count(*) from edges) as num_edges")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.network(spark, d).counts()


@query(f"{BASE} select * from fat")
def edge_fatten(spark: SparkSession, d: str) -> DataFrame:
    return B.network(spark, d).fat_edges().drop("direction")


@query(f"{BASE} select source as node_id, target, weight from edges union all select target, source, weight from edges")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    n = B.network(spark, d)
    some = n.nodes.select("node_id")
    return n.out_of(some).select("node_id", "target", "weight").union(n.into(some).select("node_id", "source", "weight"))


def _ways(spark: SparkSession, d: str) -> DataFrame:
    """A way for each order: up to four nodes, a class, and sometimes one-way."""
    k = F.col("o_orderkey")
    refs = F.transform(F.sequence(F.lit(0), (k % 3 + 1).cast("int")), lambda i: (k * 7 + i * 11) % 500)
    names = F.array(*(F.lit(c) for c in (*B.CLASS_NAMES, "footway")))
    kind = F.element_at(names, (k % 9 + 1).cast("int"))
    one = F.when(k % 5 == 0, F.lit("yes")).when(k % 5 == 1, F.lit("-1")).otherwise(F.lit("no"))
    ring = F.when(k % 11 == 0, F.lit("roundabout")).otherwise(F.lit("none"))
    return B.read(spark, d, "orders").select(k.alias("way_id"), refs.alias("refs"), F.create_map(F.lit("highway"), kind, F.lit("oneway"), one, F.lit("junction"), ring).alias("tags"))


_CLASS_LIST = ", ".join(f"'{c}'" for c in (*B.CLASS_NAMES, "footway"))
_WEIGHT_LIST = ", ".join([*(str(tags.ROAD_WEIGHTS[c]) for c in B.CLASS_NAMES), "null"])
_WAY_EDGES = f"""w as (select o_orderkey as k, [{_WEIGHT_LIST}][o_orderkey % 9 + 1] as weight, (o_orderkey % 5 in (0, 1) or o_orderkey % 11 = 0) as single from orders),
p as (select k, weight, single, i, (k * 7 + i * 11) % 500 as a, (k * 7 + (i + 1) * 11) % 500 as b from w, range(3) t(i) where weight is not null and i <= k % 3),
e as (select a as source, b as target, weight, k as way_id, 'Outgoing' as direction, i as place from p union all select b, a, weight, k, 'Incoming', i from p where not single)"""


@query(f"with {_WAY_EDGES} select source, target, weight::int as weight, way_id, direction, place::int as place from e")
def way_edges(spark: SparkSession, d: str) -> DataFrame:
    return N.way_edges(_ways(spark, d))


@query(f"with {_WAY_EDGES} select source, target, weight::int as weight, way_id, direction from (select *, row_number() over (partition by source, target order by way_id desc, place desc, direction desc) as r from e) where r = 1")
def graph_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return N.last_wins(N.way_edges(_ways(spark, d)), "way_id", "place", "direction").drop("place")


@query(f"with {_WAY_EDGES}, f as (select source, arg_min(way_id, (way_id, place, direction)) as way_id from e group by source) select source as edge_id, way_id from f")
def shard_first_meta(spark: SparkSession, d: str) -> DataFrame:
    """Of a shard, edges are named by their source, which keeps the first way's attributes."""
    rows = N.way_edges(_ways(spark, d))
    return rows.groupBy("source").agg(F.min_by("way_id", F.struct("way_id", "place", "direction")).alias("way_id")).select(F.col("source").alias("edge_id"), "way_id")


@query("select o_orderkey as k, (o_orderkey % 5 in (0, 1) or o_orderkey % 11 = 0) as single from orders")
def oneway_expand(spark: SparkSession, d: str) -> DataFrame:
    return _ways(spark, d).select(F.col("way_id").alias("k"), tags.one_way(F.col("tags")["oneway"], F.col("tags")["junction"]).alias("single"))


@query(f"select o_orderkey as k, [{_WEIGHT_LIST}][o_orderkey % 9 + 1]::int as weight from orders")
def road_class_weight(spark: SparkSession, d: str) -> DataFrame:
    return _ways(spark, d).select(F.col("way_id").alias("k"), tags.road_weight(F.col("tags")["highway"]).alias("weight"))


@query(f"{BASE} select node_id from nodes where lon between -118.29 and -118.25 and lat between 33.90 and 33.93")
def nodes_in_box(spark: SparkSession, d: str) -> DataFrame:
    return spatial.in_box(B.nodes(spark, d), -118.29, 33.90, -118.25, 33.93).select("node_id")


@query(f"{BASE} select source, target from fat where least(lon1,lon2) <= -118.25 and greatest(lon1,lon2) >= -118.29 and least(lat1,lat2) <= 33.93 and greatest(lat1,lat2) >= 33.9")
def edges_in_box(spark: SparkSession, d: str) -> DataFrame:
    return spatial.in_box(B.network(spark, d).fat_edges(), -118.29, 33.90, -118.25, 33.93).select("source", "target")


_BX, _BY = B.sql_half_box("t.lat", 150)


@query(f"{BASE} select t.trip, t.layer, n.node_id from traces t join nodes n on abs(n.lon - t.lon) <= {_BX} and abs(n.lat - t.lat) <= {_BY}")
def nodes_at_distance(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nodes_near(B.traces(spark, d).select("trip", "layer", "lon", "lat"), B.nodes(spark, d), 150.0).select("trip", "layer", "node_id")


_EX, _EY = B.sql_half_box("t.lat", 50)


@query(f"{BASE} select t.trip, t.layer, f.source, f.target from traces t join fat f on least(lon1,lon2) <= t.lon + {_EX} and greatest(lon1,lon2) >= t.lon - {_EX} and least(lat1,lat2) <= t.lat + {_EY} and greatest(lat1,lat2) >= t.lat - {_EY}")
def edges_at_distance(spark: SparkSession, d: str) -> DataFrame:
    return spatial.edges_near(B.traces(spark, d).select("trip", "layer", "lon", "lat"), B.network(spark, d).fat_edges(), 50.0).select("trip", "layer", "source", "target")


@query(f"{BASE} select k, node_id from (select t.trip * 100000 + t.layer as k, n.node_id, row_number() over (partition by t.trip, t.layer order by sqrt(pow(n.lon - t.lon, 2) + pow(n.lat - t.lat, 2)), n.node_id) as r from traces t, nodes n) where r = 1")
def nearest_node(spark: SparkSession, d: str) -> DataFrame:
    points = B.traces(spark, d).select((F.col("trip") * 100000 + F.col("layer")).alias("k"), "lon", "lat")
    return spatial.nearest_node(points, B.nodes(spark, d), "k").select("k", "node_id")


@query(f"{BASE}, s as (select case when node_id % 2 = 0 then 'a' else 'b' end as shard, * from nodes), each as (select t.trip * 100000 + t.layer as k, s.shard, s.node_id, sqrt(pow(s.lon - t.lon, 2) + pow(s.lat - t.lat, 2)) as dist from traces t, s) select k, node_id from (select *, row_number() over (partition by k order by dist, node_id) as r from each) where r = 1")
def nearest_across_shards(spark: SparkSession, d: str) -> DataFrame:
    points, nodes = B.traces(spark, d).select((F.col("trip") * 100000 + F.col("layer")).alias("k"), "lon", "lat"), B.nodes(spark, d)
    both = spatial.nearest_node(points, nodes.where("node_id % 2 = 0"), "k").union(spatial.nearest_node(points, nodes.where("node_id % 2 = 1"), "k"))
    return both.groupBy("k").agg(F.min(F.struct("distance", "node_id")).alias("b")).select("k", "b.node_id")


@query(f"{BASE} select source, target, weight, floor({B.sql_haversine('lon1', 'lat1', 'lon2', 'lat2')} * 100)::bigint as cm from fat")
def successors(spark: SparkSession, d: str) -> DataFrame:
    return B.network(spark, d).successors().select("source", "target", "weight", "cm")


def _even(spark: SparkSession, d: str) -> N.Network:
    """The network with all weights 1, where the order of a search is that of lengths."""
    n = B.network(spark, d)
    return N.Network(n.nodes, n.edges.withColumn("weight", F.lit(1)))


_CM = f"floor({B.sql_haversine('lon1', 'lat1', 'lon2', 'lat2')} * 100)::bigint"


@query(f"""{BASE.replace('with ', 'with recursive ', 1)}, s as (select source, target, {_CM} as cm from fat),
r as (select node_id as root, node_id as node, 0::bigint as cm from nodes union select r.root, s.target, r.cm + s.cm from r join s on s.source = r.node where r.cm + s.cm < 60000)
select root, node, min(cm) as cm from r group by root, node""")
def reach_bounded(spark: SparkSession, d: str) -> DataFrame:
    n = _even(spark, d)
    roots = n.nodes.select(F.col("node_id").alias("root"))
    return reach.reachable(roots, n.nodes, n.successors(), 600.0).select("root", "node", "cm")


@query()
def reach_paths(spark: SparkSession, d: str) -> DataFrame:
    n = B.network(spark, d)
    pairs = n.nodes.select(F.col("node_id").alias("root"), F.explode(F.array(F.col("node_id") + 2, F.col("node_id") + 41)).alias("dest"))
    return reach.paths(pairs, n.nodes, n.successors())


@query()
def route_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = B.network(spark, d)
    pairs = n.nodes.select(F.col("node_id").alias("root"), (F.col("node_id") + 3).alias("dest"))
    return reach.routes(pairs, n.edges, n.nodes).select("root", "dest", "cost")


_LINES = "select user_id as key, list(1 + (event_id * 13) % (select count(*) from part) order by ts, event_id) as ids from steps group by user_id"


@query(f"{BASE}, l as ({_LINES}), u as (select key, unnest(ids) as node_id, generate_subscripts(ids, 1) as pos from l) select key, row_number() over (partition by key order by pos) - 1 as pos, n.lon, n.lat from u join nodes n using (node_id)")
def node_list_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = B.read(spark, d, "part").count()
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ev = B.read(spark, d, "events").withColumn("k", k).groupBy(F.col("user_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct("k", (1 + (F.col("event_id") * 13) % n).alias("node_id")))).alias("l"))
    lists = ev.select("key", F.transform("l", lambda x: x["node_id"]).alias("ids"))
    return B.network(spark, d).resolve(lists).select("key", F.posexplode("points").alias("pos", "p")).select("key", F.col("pos").cast("long").alias("pos"), "p.lon", "p.lat")


# Trellises out of events: five layers of up to four nodes for each user; edges by a rule that leaves some out.
def _trellis(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    users = B.read(spark, d, "events").select(F.col("user_id").alias("trip")).distinct()
    layers = users.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(4))))
    nodes = layers.withColumn("node", F.explode(F.sequence(F.lit(0), (1 + (F.col("trip") + F.col("layer")) % 3).cast("int")))).withColumn("weight", (F.col("trip") * 7 + F.col("layer") * 5 + F.col("node") * 3) % 11)
    to = nodes.select("trip", (F.col("layer") - 1).alias("layer"), F.col("node").alias("to"))
    edges = nodes.select("trip", "layer", F.col("node").alias("from")).join(to, ["trip", "layer"]).withColumn("weight", (F.col("trip") * 13 + F.col("layer") * 17 + F.col("from") * 19 + F.col("to") * 23) % 97)
    edges = edges.where("(trip + layer * 3 + `from` * 5 + `to`) % 4 <> 0 and (trip % 10 <> 9 or layer <> 2)")
    return nodes, edges


_TRELLIS = """u as (select distinct user_id as trip from events), l as (select trip, i as layer from u, range(5) t(i)),
tn as (select trip, layer, j as node, (trip * 7 + layer * 5 + j * 3) % 11 as weight from l, range(4) t(j) where j <= 1 + (trip + layer) % 3),
te as (select a.trip, a.layer, a.node as f, b.node as t, (a.trip * 13 + a.layer * 17 + a.node * 19 + b.node * 23) % 97 as weight from tn a join tn b on b.trip = a.trip and b.layer = a.layer + 1
  where (a.trip + a.layer * 3 + a.node * 5 + b.node) % 4 <> 0 and (a.trip % 10 <> 9 or a.layer <> 2)),
paths as (select a.trip, n0.weight + a.weight + n1.weight + b.weight + n2.weight + c.weight + n3.weight + e.weight + n4.weight as cost, [a.f, a.t, b.t, c.t, e.t] as path
  from te a join te b on b.trip = a.trip and b.layer = 1 and b.f = a.t join te c on c.trip = a.trip and c.layer = 2 and c.f = b.t join te e on e.trip = a.trip and e.layer = 3 and e.f = c.t
  join tn n0 on n0.trip = a.trip and n0.layer = 0 and n0.node = a.f join tn n1 on n1.trip = a.trip and n1.layer = 1 and n1.node = a.t join tn n2 on n2.trip = a.trip and n2.layer = 2 and n2.node = b.t
  join tn n3 on n3.trip = a.trip and n3.layer = 3 and n3.node = c.t join tn n4 on n4.trip = a.trip and n4.layer = 4 and n4.node = e.t where a.layer = 0)"""


@query(f"with {_TRELLIS} select trip, layer, f as \"from\", t as \"to\", weight from te")
def trellis_edges(spark: SparkSession, d: str) -> DataFrame:
    return _trellis(spark, d)[1].select("trip", "layer", "from", "to", "weight")


@query(f"with {_TRELLIS} select trip, min(cost) as cost from paths group by trip")
def viterbi_cost(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _trellis(spark, d)
    return trellis.viterbi(nodes, edges).where("status = 'solved'").select("trip", "cost").distinct()


@query(f"with {_TRELLIS} select trip, min(cost) as cost from paths group by trip")
def viterbi_cost_joins(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _trellis(spark, d)
    return trellis.viterbi_costs(nodes, edges, 5)


#: Ties as the solver breaks them: the smallest end, then the smallest predecessor, from the end backwards.
@query(f"with {_TRELLIS} select trip, i - 1 as layer, path[i] as node from (select trip, path, row_number() over (partition by trip order by cost, path[5], path[4], path[3], path[2], path[1]) as r from paths), range(1, 6) t(i) where r = 1")
def viterbi_path(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _trellis(spark, d)
    return trellis.viterbi(nodes, edges).where("status = 'solved'").select("trip", F.col("layer").cast("long").alias("layer"), F.col("node").cast("long").alias("node"))


@query(f"with {_TRELLIS} select trip, min(cost) as cost, arg_min(path, (cost, path))[5] as last from paths group by trip")
def brute_force_cost(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _trellis(spark, d)
    return trellis.brute_force(nodes, edges, 5).select("trip", "cost", F.element_at("path", 5).cast("long").alias("last"))


@query(f"with {_TRELLIS} select u.trip, i as layer from u, range(4) t(i) where not exists (select 1 from te where te.trip = u.trip and te.layer = i)")
def disconnections(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _trellis(spark, d)
    return trellis.disconnections(nodes, edges).select("trip", F.col("layer").cast("long").alias("layer"))


@query()
def convergence(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _trellis(spark, d)
    return trellis.viterbi(nodes, edges).select("trip", "status", "convergence").distinct()


@query(f"with {_TRELLIS} select trip, layer - 2 as layer, node, weight from tn where layer >= 2")
def trip_tail(spark: SparkSession, d: str) -> DataFrame:
    return trellis.tail(_trellis(spark, d)[0], 3).select("trip", F.col("layer").cast("long").alias("layer"), F.col("node").cast("long").alias("node"), "weight")


@query(f"with {_TRELLIS}, w as (select trip, layer, count(*) as width from tn group by trip, layer) select trip, layer, width, coalesce(sum(width) over (partition by trip order by layer rows between unbounded preceding and 1 preceding), 0)::bigint as first from w")
def layer_offsets(spark: SparkSession, d: str) -> DataFrame:
    widths = _trellis(spark, d)[0].groupBy("trip", F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("width"))
    before = Window.partitionBy("trip").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    return widths.withColumn("first", F.coalesce(F.sum("width").over(before), F.lit(0)))
