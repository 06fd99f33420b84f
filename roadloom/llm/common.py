"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every contract here: a word is a longest run of other characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; one of our own is set only where the session names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            named = "file://" + tempfile.mkdtemp(prefix="roadloom-")
            sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written as Parquet in the shared folder, so that lost executors cost no recomputation of what stands before them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        drop(*frames)


def drop(*frames: DataFrame) -> None:
    """Deletes tables of put() or held() that no later step reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held(df: DataFrame) -> DataFrame:
    """df as a written table: computed once, its lineage cut, and its size known to the planner.

    (A checkpoint computes its plan twice, and keeps estimates of size that multiply with each join of an iteration.)
    """
    return Scratch(df.sparkSession, "held").put(df)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a Python worker's function of batches, that gives the memory it has freed back to the machine at its task's end: idle workers stay for later tasks,
    and the allocators would keep what the largest task needed."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without an array of the words: white space is mapped to spaces and the borders counted."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def join_hot(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which any may be hot in `big`, to unique keys in `small`; the same plan at any size.

    It is a sort-merge join, of which AQE splits the partitions that hot keys swell, since nothing here needs the rows dealt by the same keys afterwards.  AQE
    does so only where both sides are shuffled right before: coalesce() to no fewer partitions moves nothing, but lets the planner forget that an aggregate
    has left `small` dealt by its keys.  Only where `small` is known to be below spark.sql.autoBroadcastJoinThreshold is it broadcast.
    """
    return big.join(small.coalesce(1 << 20), list(on), how)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns, lengthened until df has none of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bucket_bits(rows: int, per_bucket: int = 20_000) -> int:
    return max(6, math.ceil(math.log2(max(1, rows) / per_bucket + 1)))


def running(df: DataFrame, keys: Sequence[str], order: str, tie: str, value: Column, out: str, bits: int) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that stand before this one, by `order` (an evenly spread hash from 0 to 2**63 - 1) and `tie`.

    Rows are dealt by keys and the first bits of the hash, so no key is ever in one task; sums by bucket give each bucket its start.  Keys mustn't be null.
    """
    bucket, v, start, total = free(df, "_b", "_v", "_start", "_t")
    df = df.withColumn(bucket, F.shiftright(F.col(order), 63 - bits)).withColumn(v, value)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, bucket).agg(F.sum(v).alias(total)).select(*keys, bucket, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    inner = Window.partitionBy(*keys, bucket).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts, [*keys, bucket])
    return joined.withColumn(out, F.col(start) + F.coalesce(F.sum(v).over(inner), F.lit(0))).drop(bucket, v, start)


def ranked(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Adds `out`: the row's place from 0 in the order, over ranges sorted apart; only the number of rows of each range meets in one task."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = held(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    start = ranges.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    result = ranges.join(start, "_part").withColumn(out, (F.col("_start") + place).cast("long")).drop("_part", "_start")
    result._under = ranges  # drop() may have it once the result is written
    return result


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
