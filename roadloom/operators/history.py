"""Vehicle histories: gates, cuts, overlaps and merges, as window functions; the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geo


def fresh(events: DataFrame, key: str = "vehicle_id", ts: str = "ts", arrival: str = "seq") -> DataFrame:
    """Events that are later than all that arrived before them for their vehicle."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_last", F.max(ts).over(before)).where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")


def newest(events: DataFrame, n: int, key: str = "vehicle_id", ts: str = "ts", tie: str = "seq") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def distinct_steps(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """Without rows whose value equals the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_v", value).withColumn("_b", F.lag("_v").over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_v").eqNullSafe(F.col("_b"))).drop("_v", "_b", "_n")


def since_gap(events: DataFrame, gap_s: float = 120.0, jump_m: float = 2000.0, key: str = "vehicle_id", tie: str = "seq") -> DataFrame:
    """Each vehicle's newest events up to the first step, backwards, that took longer than the gap or went farther than the jump."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col(tie).desc())
    later_ts, later_lon, later_lat = (F.lag(c).over(w) for c in ("ts", "lon", "lat"))
    rows = events.withColumn("_dt", later_ts.cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")).withColumn("_d", geo.haversine("lon", "lat", later_lon, later_lat))
    rows = rows.withColumn("_cut", F.coalesce((F.col("_dt") > gap_s) | (F.col("_d") > jump_m), F.lit(False)).cast("int"))
    rows = rows.withColumn("_cuts", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_cuts = 0").drop("_dt", "_d", "_cut", "_cuts")


def overlap(trip: Column, history: Column) -> Column:
    """The longest k for which the trip's last k observations are the history's first k, exactly; 0 if there is none: then the trip restarts."""
    most = F.least(F.size(trip), F.size(history))
    fits = F.filter(F.sequence(F.lit(0), most), lambda k: (k == 0) | (F.slice(trip, F.size(trip) - k + 1, k) == F.slice(history, F.lit(1), k)))
    return F.array_max(fits)


def merged(emissions: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """One row for each vehicle and time: that of the highest revision."""
    rest = [c for c in emissions.columns if c not in (key, "ts", "revision")]
    return emissions.groupBy(key, "ts").agg(F.max(F.struct("revision", *rest)).alias("e")).select(key, "ts", "e.*")


def nearest_rank(rows: DataFrame, key: str, value: str, percents: tuple[int, ...] = (15, 25, 50, 75, 85)) -> DataFrame:
    """Nearest-rank percentiles, with count, least, most and mean."""
    picks = [F.expr(f"percentile_disc({p / 100}) within group (order by {value})").alias(f"p{p}") for p in percents]
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), *picks)


def paced(events: DataFrame, speed: float, ts: str = "ts") -> DataFrame:
    """Events with due: seconds after a replay's start at which each is sent; without a speed above 0 all are due at once."""
    if speed <= 0:
        return events.withColumn("due", F.lit(0.0))
    at = F.col(ts).cast("timestamp").cast("double")
    first = events.agg(F.min(at).alias("_first"))
    return events.crossJoin(F.broadcast(first)).withColumn("due", (at - F.col("_first")) / F.lit(float(speed))).drop("_first")  # a row of one number


def sorted_out(rows: DataFrame, parsed: str) -> tuple[DataFrame, DataFrame]:
    """Messages that were understood, and those that weren't, which are set aside instead of stopping a stream."""
    return rows.where(F.col(parsed).isNotNull()), rows.where(F.col(parsed).isNull())


def outcome(status: Column) -> Column:
    """struct<matched, fatal>: a trip without a way or a road is nothing unusual; any other failure is."""
    nominal = status.isin("solved", "unanchored", "disconnected", "unreachable")
    return F.struct((status == "solved").alias("matched"), (~nominal).alias("fatal"))


def store_statistics(events: DataFrame, recent_s: float = 3600.0) -> DataFrame:
    """vehicles, total and recent: how many vehicles and events there are, and how many events of the last recent_s seconds."""
    at = F.col("ts").cast("timestamp").cast("double")
    last = events.agg(F.max(at).alias("_last"))
    own = events.crossJoin(F.broadcast(last))  # a row of one number
    return own.agg(F.count_distinct("vehicle_id").alias("vehicles"), F.count("*").alias("total"), F.count_if(at > F.col("_last") - recent_s).alias("recent"))
