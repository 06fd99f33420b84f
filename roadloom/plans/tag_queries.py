"""Tags: access, modes, speeds, lanes, opening hours, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import hours, tags
from roadloom.plans import bridge as B
from roadloom.plans.registry import query

_ACCESS = ("yes", "no", "private", "destination")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Access tags of each order: for all, for vehicles going forward, and for cars."""
    k = F.col("o_orderkey")
    values = F.array(*(F.lit(v) for v in _ACCESS))

    def pick(x):
        return F.element_at(values, (x % 4 + 1).cast("int"))

    all_ = F.create_map(F.lit("access"), pick(k), F.lit("vehicle:forward"), pick(F.floor(k / 4)), F.lit("motorcar"), pick(F.floor(k / 16)), F.lit("name"), F.lit("yes"))
    return B.read(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, F.map_filter(all_, lambda a, b: a == "access")).when(k % 3 == 1, F.map_filter(all_, lambda a, b: a != "motorcar")).otherwise(all_).alias("tags"))


_PICK = "['yes', 'no', 'private', 'destination']"


@query(f"select o_orderkey as k, (case when o_orderkey % 3 = 0 then {_PICK}[o_orderkey % 4 + 1] when o_orderkey % 3 = 1 then {_PICK}[o_orderkey // 4 % 4 + 1] else {_PICK}[o_orderkey // 16 % 4 + 1] end) = 'yes' as open, (case when o_orderkey % 3 = 2 then {_PICK}[o_orderkey // 16 % 4 + 1] else {_PICK}[o_orderkey % 4 + 1] end) in ('yes', 'private') as open_back from orders")
def access_allowed(spark: SparkSession, d: str) -> DataFrame:
    rules = _tagged(spark, d).withColumn("rules", tags.access_rules(F.col("tags")))
    return rules.select("k", tags.accessible(F.col("rules"), "motorcar", F.lit("forward")).alias("open"), tags.accessible(F.col("rules"), "motorcar", F.lit("backward"), True).alias("open_back"))


@query("select o_orderkey as k, case o_orderkey % 3 when 0 then 1 when 1 then 2 else 3 end as n from orders")
def access_parse(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d).select("k", F.size(tags.access_rules(F.col("tags"))).alias("n"))


_PARENTS = ", ".join(f"('{m}', {'null' if p is None else repr(p)})" for m, p in tags.MODE_PARENTS.items())


@query(f"with recursive p(mode, parent) as (values {_PARENTS}), c as (select mode, mode as ancestor, parent as up, 0 as h from p union all select c.mode, p.mode, p.parent, c.h + 1 from c join p on p.mode = c.up) select mode, ancestor, max(h) over (partition by mode) - h + 1 as depth from c")
def mode_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return tags.mode_closure(spark)


def _speeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*(F.lit(u) for u in ("", " mph", " kph", " knots", "mph"))), (k % 5 + 1).cast("int"))
    text = F.when(k % 17 == 0, F.lit("none")).when(k % 19 == 0, F.lit("walk")).otherwise(F.concat((k % 130).cast("string"), unit))
    return B.read(spark, d, "orders").select(k.alias("k"), text.alias("value"))


@query("select o_orderkey as k, case when o_orderkey % 17 = 0 or o_orderkey % 19 = 0 or o_orderkey % 130 = 0 then null when o_orderkey % 5 in (1, 4) then floor((o_orderkey % 130) * 1.609344::double)::int when o_orderkey % 5 = 3 then floor((o_orderkey % 130) * 1.852::double)::int else (o_orderkey % 130)::int end as kmh from orders")
def speed_kmh(spark: SparkSession, d: str) -> DataFrame:
    rows = _speeds(spark, d).select("k", tags.speed_kmh(F.col("value")).alias("kmh"))
    return rows.withColumn("kmh", F.when(F.col("kmh") > 0, F.col("kmh")))


@query("select o_orderkey as k, case when o_orderkey % 2 = 0 then [(o_orderkey % 90 + 10)::int, 50] else [(o_orderkey % 90 + 10)::int] end as speeds from orders")
def speed_relevant(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = F.concat((k % 90 + 10).cast("string"))
    tag = F.when(k % 2 == 0, F.create_map(F.lit("maxspeed"), own, F.lit("maxspeed:motorcar:forward"), F.lit("50"), F.lit("maxspeed:bus"), F.lit("30"))).otherwise(F.create_map(F.lit("maxspeed:lanes"), F.concat(own, F.lit("|80")), F.lit("maxspeed:backward"), F.lit("40"), F.lit("name"), F.lit("x")))
    return B.read(spark, d, "orders").select(k.alias("k"), tags.relevant_speed(tags.speed_limits(tag), "motorcar", "forward", 0).alias("speeds"))


@query("select o_orderkey as k, i as lane, case when (o_orderkey + i) % 3 = 0 then null else (o_orderkey + i)::varchar end as value from orders, range(4) t(i) where i <= o_orderkey % 3 and (i < o_orderkey % 3 or (o_orderkey + i) % 3 <> 0)")
def lane_split(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.when((k + i) % 3 == 0, F.lit("")).otherwise((k + i).cast("string"))), "|")
    return B.read(spark, d, "orders").select(k.alias("k"), F.posexplode(tags.lanes(text)).alias("lane", "value")).withColumn("lane", F.col("lane").cast("long")).where("value is not null or lane < k % 3")


_HOURS = ("24/7", "09:00-17:00", "Mo,We 22:00-06:00", "Sa 10:00-14:00; Su closed", "closed")


@query("""select o_orderkey as k, case o_orderkey % 5 when 0 then true when 1 then m between 540 and 1020 when 2 then w in (0, 2) and (m >= 1320 or m <= 360) when 3 then w = 5 and m between 600 and 840 else false end as open
from (select o_orderkey, o_orderkey // 5 % 7 as w, o_orderkey * 37 % 1440 as m from orders)""")
def opening_open_at(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = B.read(spark, d, "orders").select(k.alias("k"), F.element_at(F.array(*(F.lit(h) for h in _HOURS)), (k % 5 + 1).cast("int")).alias("text"), (F.floor(k / 5) % 7).cast("int").alias("w"), (k * 37 % 1440).cast("int").alias("m"))
    return rows.withColumn("rules", hours.opening_rules(F.col("text"))).select("k", hours.open_at(F.col("rules"), F.col("w"), F.col("m")).alias("open"))


@query()
def condition_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    texts = ("weight < 7.5", "winter", "Mo-Fr 07:00-09:00", "(length > 10 AND wet)", "destination", "trailers >= 1 OR snow")
    rows = B.read(spark, d, "orders").select(k.alias("k"), F.element_at(F.array(*(F.lit(t) for t in texts)), (k % 6 + 1).cast("int")).alias("text"))
    return rows.select("k", hours.condition(F.col("text")).alias("c")).select("k", "c.*")


@query("select k, case when k % 2 = 0 then make_timestamp(2024, 1, 1 + (k % 28)::int, (k % 24)::int, 5, 6.0::double) when k % 3 = 0 then make_timestamp(2024, 1, 1 + (k % 28)::int, (k % 24)::int, 5, 6.25::double) end as ts from (select o_orderkey as k from orders)")
def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day, hour = F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lpad((k % 24).cast("string"), 2, "0")
    stem = F.concat(F.lit("2024-01-"), day, F.lit(" "), hour, F.lit(":05:06"))
    text = F.when(k % 2 == 0, F.concat(stem, F.lit(" UTC"))).when(k % 3 == 0, F.concat(stem, F.lit(".25 UTC"))).otherwise(F.lit("not a time"))
    from roadloom.sources.replay import event_time

    return B.read(spark, d, "orders").select(k.alias("k"), event_time(text).cast("timestamp_ntz").alias("ts"))
