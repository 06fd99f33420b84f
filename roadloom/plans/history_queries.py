"""Histories of vehicles, merges, statistics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import hashing
from roadloom.operators import history
from roadloom.plans import bridge as B
from roadloom.plans.registry import query

_EV = "ev as (select user_id as vehicle_id, event_id as seq, ts, -118.3::double + 0.01::double * (event_id % 5) as lon, 33.9::double + 0.002::double * (floor(value * 100)::bigint % 4) as lat from events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "events").select(
        F.col("user_id").alias("vehicle_id"), F.col("event_id").alias("seq"), "ts", (F.lit(-118.3) + F.lit(0.01) * (F.col("event_id") % 5)).alias("lon"), (F.lit(33.9) + F.lit(0.002) * (F.floor(F.col("value") * 100) % 4)).alias("lat")
    )


@query(f"with {_EV} select vehicle_id, seq from (select *, max(ts) over (partition by vehicle_id order by seq rows between unbounded preceding and 1 preceding) as last from ev) where last is null or ts > last")
def stale_gate(spark: SparkSession, d: str) -> DataFrame:
    return history.fresh(_events(spark, d)).select("vehicle_id", "seq")


@query(f"with {_EV} select vehicle_id, seq from (select *, row_number() over (partition by vehicle_id order by ts desc, seq desc) as r from ev) where r <= 5")
def newest_n(spark: SparkSession, d: str) -> DataFrame:
    return history.newest(_events(spark, d), 5).select("vehicle_id", "seq")


@query(f"with {_EV} select vehicle_id, seq from (select *, lag(lat) over (partition by vehicle_id order by seq) as b, row_number() over (partition by vehicle_id order by seq) as r from ev) where r = 1 or lat is distinct from b")
def consecutive_dedup(spark: SparkSession, d: str) -> DataFrame:
    return history.distinct_steps(_events(spark, d), "vehicle_id", "seq", F.col("lat")).select("vehicle_id", "seq")


_GAP_S = 14400


@query(f"""with {_EV}, s as (select *, lag(ts) over w as lt, lag(lon) over w as llon, lag(lat) over w as llat from ev window w as (partition by vehicle_id order by ts desc, seq desc)),
c as (select *, case when lt is not null and coalesce(epoch(lt) - epoch(ts) > {_GAP_S} or {B.sql_haversine('lon', 'lat', 'llon', 'llat')} > 3500, false) then 1 else 0 end as cut from s)
select vehicle_id, seq from (select *, sum(cut) over (partition by vehicle_id order by ts desc, seq desc rows between unbounded preceding and current row) as cuts from c) where cuts = 0""")
def gap_cut(spark: SparkSession, d: str) -> DataFrame:
    return history.since_gap(_events(spark, d), _GAP_S, 3500.0).select("vehicle_id", "seq")


@query("""with s as (select o_custkey as k, (o_orderkey % 3)::int as v, row_number() over (partition by o_custkey order by o_orderkey) as r, count(*) over (partition by o_custkey) as n from orders),
a as (select k, list(v order by r) filter (where 3 * r <= 2 * n) as t, list(v order by r) filter (where 3 * r > n) as h from s group by k)
select k, coalesce(list_max([i for i in range(1, least(len(t), len(h)) + 1) if t[len(t) - i + 1:len(t)] = h[1:i]]), 0)::int as keep from a where h is not null""")
def reconcile_overlap(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    s = B.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).cast("int").alias("v"), r.alias("r"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))

    def listed(rule):
        return F.transform(F.sort_array(F.collect_list(F.when(rule, F.struct("r", "v")))), lambda x: x["v"])

    rows = s.groupBy("k").agg(listed(3 * F.col("r") <= 2 * F.col("n")).alias("t"), listed(3 * F.col("r") > F.col("n")).alias("h")).where(F.size("h") > 0)
    return rows.select("k", history.overlap(F.col("t"), F.col("h")).alias("keep"))


@query("select vehicle_id, slot as ts, seq as revision, event_type as kind from (select user_id as vehicle_id, event_id // 50 as slot, event_id as seq, event_type, row_number() over (partition by user_id, event_id // 50 order by event_id desc) as r from events) where r = 1")
def emission_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = B.read(spark, d, "events").select(F.col("user_id").alias("vehicle_id"), F.floor(F.col("event_id") / 50).alias("ts"), F.col("event_id").alias("revision"), F.col("event_type").alias("kind"))
    return history.merged(rows)


@query("""with s as (select event_type as k, value as v, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events)
select k, max(n) as n, min(v) as least, max(v) as most, round(avg(v), 6) as mean, max(case when r = ceil(0.15 * n) then v end) as p15, max(case when r = ceil(0.25 * n) then v end) as p25, max(case when r = ceil(0.5 * n) then v end) as p50, max(case when r = ceil(0.75 * n) then v end) as p75, max(case when r = ceil(0.85 * n) then v end) as p85 from s group by k""")
def percentiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = B.read(spark, d, "events").select(F.col("event_type").alias("k"), F.col("value").alias("v"))
    return history.nearest_rank(rows, "k", "v").withColumn("mean", F.round("mean", 6))


@query("select event_type as k, count(*) as n, round(count(*) / sum(value) * 1000, 6) as per_second from events group by event_type")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    return B.read(spark, d, "events").groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum("value") * 1000, 6).alias("per_second"))


@query("select date_trunc('hour', ts) as hour, event_type as kind, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1, 2")
def span_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = B.read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("kind"))
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    rows = rows.agg(F.count("*").alias("n"), q.alias("q"))
    return rows.select("hour", "kind", "n", *(F.round(F.get("q", i), 6).alias(f"p{p}") for i, p in enumerate((50, 95, 99))))


@query("select count(distinct user_id) as vehicles, count(*) as total, count(*) filter (where epoch(ts) > (select max(epoch(ts)) from events) - 3600) as recent from events")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    return history.store_statistics(B.read(spark, d, "events").withColumnRenamed("user_id", "vehicle_id"))


@query(f"""with recursive n as (select distinct user_id, 'vehicle-' || user_id as t from events),
b as (select user_id, t, 1 as i, {hashing.FNV_OFFSET}::uhugeint as h from n
union all select user_id, t, i + 1, (xor(h, ascii(substr(t, i, 1))::uhugeint) * {hashing.FNV_PRIME}::uhugeint) % 18446744073709551616::uhugeint from b where i <= length(t)),
v as (select user_id, (case when h >= 9223372036854775808::uhugeint then h::hugeint - 18446744073709551616::hugeint else h::hugeint end)::bigint as vehicle_id from b where i = length(t) + 1)
select vehicle_id, date_trunc('second', ts) as ts, -118.3::double as lon, 33.9::double + value / 1e6 as lat from events join v using (user_id)""")
def replay_parse(spark: SparkSession, d: str) -> DataFrame:
    from roadloom.sources.replay import replay_rows

    ev = B.read(spark, d, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = ev.select(F.concat(F.lit("vehicle-"), F.col("user_id").cast("string")).alias("VehicleID"), F.lit("p").alias("Provider"), F.concat(text, F.lit(" UTC")).alias("EventTime"), (F.lit(33.9) + F.col("value") / 1e6).alias("Latitude"), F.lit(-118.3).alias("Longitude"))
    return replay_rows(raw)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return B.traces(spark, d).select(F.col("trip").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("ts"), "lon", "lat")


@query()
def vehicles_matched(spark: SparkSession, d: str) -> DataFrame:
    """Each vehicle's events as one trip, by the stream's matcher over a table; tests hold a real stream against it."""
    from roadloom.streaming.matcher import match_batch

    return match_batch(_observations(spark, d), B.network(spark, d))
