"""Geodesy, cells and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import cells, geo, hashing
from roadloom.operators import placement
from roadloom.plans import bridge as B
from roadloom.plans.registry import query

BASE = B.BASE_SQL
LETTERS = cells.BASE32


def _fat(spark: SparkSession, d: str) -> DataFrame:
    return B.network(spark, d).fat_edges()


@query(f"{BASE} select source, target, round({B.sql_haversine('lon1', 'lat1', 'lon2', 'lat2')}, 6) as metres from fat")
def geo_haversine(spark: SparkSession, d: str) -> DataFrame:
    return _fat(spark, d).select("source", "target", F.round(geo.haversine("lon1", "lat1", "lon2", "lat2"), 6).alias("metres"))


@query(f"{BASE} select source, target, round({B.sql_bearing('lon1', 'lat1', 'lon2', 'lat2')}, 6) as heading from fat")
def geo_bearing(spark: SparkSession, d: str) -> DataFrame:
    return _fat(spark, d).select("source", "target", F.round(geo.bearing("lon1", "lat1", "lon2", "lat2"), 6).alias("heading"))


@query(f"{BASE} select source, target, least(lon1,lon2) as west, least(lat1,lat2) as south, greatest(lon1,lon2) as east, greatest(lat1,lat2) as north from fat")
def geo_envelope(spark: SparkSession, d: str) -> DataFrame:
    return _fat(spark, d).select("source", "target", F.least("lon1", "lon2").alias("west"), F.least("lat1", "lat2").alias("south"), F.greatest("lon1", "lon2").alias("east"), F.greatest("lat1", "lat2").alias("north"))


@query("select o_orderkey as k, round(case when o_totalprice <= 1000 then 1.0 else 1000.0/o_totalprice end, 9) as deviance from orders")
def geo_deviance(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("o_totalprice") <= 1000, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return B.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round(geo.deviance(F.lit(1000.0), price), 9).alias("deviance"))


@query(f"with {B.NODES_SQL} select node_id, round(lon - 1000/111320.0/greatest(cos(radians(lat)),1e-6), 9) as west, round(lat - 1000/111320.0, 9) as south, round(lon + 1000/111320.0/greatest(cos(radians(lat)),1e-6), 9) as east, round(lat + 1000/111320.0, 9) as north from nodes")
def geo_padded_bounds(spark: SparkSession, d: str) -> DataFrame:
    dx, dy = geo.padding(1000.0, "lat")
    return B.nodes(spark, d).select("node_id", F.round(F.col("lon") - dx, 9).alias("west"), F.round(F.col("lat") - dy, 9).alias("south"), F.round(F.col("lon") + dx, 9).alias("east"), F.round(F.col("lat") + dy, 9).alias("north"))


def _sql_geohash(lon: str, lat: str, precision: int) -> str:
    bits = 5 * precision
    xb, yb = (bits + 1) // 2, bits // 2
    x, y = f"least(greatest(floor(({lon}+180.0)/360.0*{1 << xb}.0),0),{(1 << xb) - 1})::bigint", f"least(greatest(floor(({lat}+90.0)/180.0*{1 << yb}.0),0),{(1 << yb) - 1})::bigint"
    letters = []
    for k in range(precision):
        bit = [f"((({x}) >> {xb - 1 - i // 2}) & 1)" if i % 2 == 0 else f"((({y}) >> {yb - 1 - i // 2}) & 1)" for i in range(5 * k, 5 * k + 5)]
        letters.append(f"substr('{LETTERS}', ({'+'.join(f'{b}*{16 >> j}' for j, b in enumerate(bit))})::int + 1, 1)")
    return "(" + " || ".join(letters) + ")"


@query(f"with {B.NODES_SQL} select node_id, {_sql_geohash('lon', 'lat', 6)} as cell from nodes")
def geohash_encode(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).select("node_id", cells.geohash("lon", "lat", 6).alias("cell"))


@query(f"with {B.NODES_SQL} select distinct {_sql_geohash('lon', 'lat', 5)} as cell, floor((lon+180)/(360.0/8192))*(360.0/8192)-180 as west, floor((lat+90)/(180.0/4096))*(180.0/4096)-90 as south, (floor((lon+180)/(360.0/8192))+1)*(360.0/8192)-180 as east, (floor((lat+90)/(180.0/4096))+1)*(180.0/4096)-90 as north from nodes")
def geohash_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = B.nodes(spark, d).select(cells.geohash("lon", "lat", 5).alias("cell")).distinct()
    w, s, e, n = cells.geohash_bounds(F.col("cell"), 5)
    return rows.select("cell", w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))


_PROBES = [(dx, dy) for dy in (1, 0, -1) for dx in (-1, 0, 1) if dx or dy]
_CX, _CY = "(floor((lon+180)/(360.0/8192))*(360.0/8192)-180+180.0/8192)", "(floor((lat+90)/(180.0/4096))*(180.0/4096)-90+90.0/4096)"


@query(f"with {B.NODES_SQL}, probes as (select lon, lat, p[1] as dx, p[2] as dy from nodes, (select unnest({[list(p) for p in _PROBES]}) as p)) select distinct {_sql_geohash('lon', 'lat', 5)} as cell, {_sql_geohash(f'({_CX}+dx*0.75*360.0/8192)', f'({_CY}+dy*0.75*180.0/4096)', 5)} as neighbour from probes")
def geohash_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).select(cells.geohash("lon", "lat", 5).alias("cell"), F.explode(cells.geohash_neighbours("lon", "lat", 5)).alias("neighbour")).distinct()


def _sql_quadkey(depth: int) -> str:
    x, y = f"least(greatest(floor((lon+180.0)/360.0*{1 << depth}.0),0),{(1 << depth) - 1})::bigint", f"least(greatest(floor((lat+90.0)/180.0*{1 << depth}.0),0),{(1 << depth) - 1})::bigint"
    return "+".join(f"((((({x}) >> {depth - 1 - k}) & 1) + 2 * ((({y}) >> {depth - 1 - k}) & 1)) << {2 * k})" for k in range(depth))


@query(f"with {B.NODES_SQL} select node_id, ({_sql_quadkey(14)})::bigint as quadkey from nodes")
def quadkey_encode(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).select("node_id", cells.quadkey("lon", "lat", 14).alias("quadkey"))


@query(f"with {B.NODES_SQL}, h as (select node_id, {_sql_geohash('lon', 'lat', 8)} as cell from nodes) select node_id, list_sum([(instr('{LETTERS}', substr(cell, k::int, 1))::hugeint - 1) * (2::hugeint ** (8 * (k - 1) + 3))::hugeint for k in range(1, 9)])::hugeint % 9223372036854775808::hugeint - (case when ((instr('{LETTERS}', substr(cell, 8, 1)) - 1) >= 16) then 9223372036854775808::hugeint else 0 end) as number from h".replace("select node_id, list_sum", "select node_id, (list_sum").replace(" as number from h", ")::bigint as number from h"))
def geohash_u64(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).select("node_id", cells.geohash_number(cells.geohash("lon", "lat", 8)).alias("number"))


@query(f"with {B.NODES_SQL}, t as (select node_id, 262144.0*((lon+180.0)/360.0) as x, 262144.0*(1.0-ln(tan(lat*0.0174533)+1.0/cos(lat*0.0174533))/pi())/2.0 as y from nodes) select node_id, floor(x)::bigint as x, floor(y)::bigint as y, floor(4096*(x-floor(x)))::bigint as dx, floor(4096*(y-floor(y)))::bigint as dy from t")
def slippy_tile(spark: SparkSession, d: str) -> DataFrame:
    x, y, dx, dy = cells.tile_place("lon", "lat", 18)
    return B.nodes(spark, d).select("node_id", x.cast("long").alias("x"), y.cast("long").alias("y"), dx.cast("long").alias("dx"), dy.cast("long").alias("dy"))


@query("select s_suppkey as k, (s_suppkey % 512) * 4 + i % 4 as x, (s_suppkey // 512) * 4 + i // 4 as y from supplier, range(16) t(i)")
def tile_children(spark: SparkSession, d: str) -> DataFrame:
    kids = cells.tile_children(F.col("s_suppkey") % 512, F.floor(F.col("s_suppkey") / 512), 2)
    return B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(kids).alias("t")).select("k", "t.x", "t.y")


@query("""with recursive s as (select p_partkey as k, (p_partkey % 64)::bigint as x, (p_partkey // 64 % 64)::bigint as y, 0::bigint as d, 32::bigint as side from part
union all select k, case when ry = 0 then (case when rx = 1 then 63 - y else y end) else x end, case when ry = 0 then (case when rx = 1 then 63 - x else x end) else y end, d + side * side * xor(3 * rx, ry), side // 2
from (select *, (x & side > 0)::bigint as rx, (y & side > 0)::bigint as ry from s where side > 0)) select k, d as place from s where side = 0""")
def hilbert_index(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("k"), cells.hilbert(F.col("p_partkey") % 64, F.floor(F.col("p_partkey") / 64) % 64, 6).alias("place"))


@query("select o_orderkey as k, xor((o_orderkey - 5000) << 1, (o_orderkey - 5000) >> 31)::bigint as z from orders where o_orderkey >= 5000")
def mvt_zigzag(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "orders").where("o_orderkey >= 5000").select(F.col("o_orderkey").alias("k"), cells.zigzag(F.col("o_orderkey") - 5000).alias("z"))


def _signed(x: str) -> str:
    return f"(case when {x} >= 9223372036854775808::uhugeint then ({x})::hugeint - 18446744073709551616::hugeint else ({x})::hugeint end)::bigint"


@query(f"""with recursive b as (select c_custkey as k, c_name as t, 1 as i, {hashing.FNV_OFFSET}::uhugeint as h from customer
union all select k, t, i + 1, (xor(h, ascii(substr(t, i, 1))::uhugeint) * {hashing.FNV_PRIME}::uhugeint) % 18446744073709551616::uhugeint from b where i <= length(t))
select k, {_signed('h')} as h from b where i = length(t) + 1""")
def hash_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), hashing.fnv1a64(F.col("c_name")).alias("h"))


_M = "18446744073709551616::uhugeint"
_MIXED = f"""x as (select c_custkey as k, c_custkey::uhugeint as v from customer), a as (select k, (xor(v, v // 1073741824::uhugeint) % 4294967296::uhugeint) as lo, xor(v, v // 1073741824::uhugeint) // 4294967296::uhugeint as hi from x),
b as (select k, (lo * {hashing.MIX_1}::uhugeint + ((hi * {hashing.MIX_1}::uhugeint) % 4294967296::uhugeint) * 4294967296::uhugeint) % {_M} as v from a),
c as (select k, xor(v, v // 134217728::uhugeint) as v from b), e as (select k, v % 4294967296::uhugeint as lo, v // 4294967296::uhugeint as hi from c),
f as (select k, (lo * {hashing.MIX_2}::uhugeint + ((hi * {hashing.MIX_2}::uhugeint) % 4294967296::uhugeint) * 4294967296::uhugeint) % {_M} as v from e),
g as (select k, xor(v, v // 2147483648::uhugeint) as v from f)"""


@query(f"with {_MIXED} select k, {_signed('v')} as h from g")
def hash_splitmix(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), hashing.mix64(F.col("c_custkey")).alias("h"))


@query(f"with {_MIXED} select k, (v % 1024::uhugeint)::int as partition from g")
def vehicle_partition(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), hashing.vehicle_partition(F.col("c_custkey")).alias("partition"))


_MIX_M = _MIXED[_MIXED.index(", a as") + 2 :]


@query(f"""with recursive n as (select c_name as t from customer union select n_name from nation),
bytes as (select t, 1 as i, {hashing.FNV_OFFSET}::uhugeint as h from n
union all select t, i + 1, (xor(h, ascii(substr(t, i, 1))::uhugeint) * {hashing.FNV_PRIME}::uhugeint) % {_M} from bytes where i <= length(t)),
hash as (select t, h from bytes where i = length(t) + 1),
x as (select row(c_custkey, n_name, s.h) as k, xor(h.h, s.h) as v from customer join hash h on h.t = c_name, nation join hash s on s.t = n_name),
{_MIX_M}
select k[1] as k, arg_max(k[2], (v, k[3])) as store from g group by k[1]""")
def rendezvous_placement(spark: SparkSession, d: str) -> DataFrame:
    """Of the stores (nations), the one that each customer's history is kept on."""
    stores = B.read(spark, d, "nation").select(F.col("n_name").alias("store"), hashing.fnv1a64(F.col("n_name")).alias("seed"))
    keys = B.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), hashing.fnv1a64(F.col("c_name")).alias("h"))
    return placement.placed(keys, stores, "k", "store")


@query("select c_custkey as k, (c_custkey % 1024) // 171 as stream, 'EVENTS-RAW-' || ((c_custkey % 1024) // 171) as name, 'events.raw.p.' || (c_custkey % 1024) as subject from customer")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("c_custkey") % 1024
    s = placement.stream_of(p, 6)
    return B.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), s.alias("stream"), placement.stream_name(s).alias("name"), placement.subject(p).alias("subject"))


@query("select n_nationkey as fleet, o as ordinal, o * (1024 // (n_nationkey + 1)) as first, case when o = n_nationkey then 1023 else (o + 1) * (1024 // (n_nationkey + 1)) - 1 end as last from nation, range(25) t(o) where o <= n_nationkey")
def fleet_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = B.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("fleet"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_nationkey").cast("long"))).alias("ordinal"))
    first, last = placement.fleet_slice(F.col("ordinal"), F.col("fleet") + 1)
    return rows.select("fleet", "ordinal", first.alias("first"), last.alias("last"))
