"""Operator 4: mixing sources to target weights by capped water-filling.

Every source wants its weight's share of the budget; sources above `max_epochs` times their size are clamped there, and what they leave is shared by
weight among the others until none is above.  The water level is found by one small aggregate a round.  Then each source's documents are taken
floor(target / size) times, and a seeded random order of them is taken once more up to the fractional part, so the words taken differ from the target
by half a document at most; rows that the order can't tell apart are counted one by one.  DataFrame operations only.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in order; repeated rows count each; an
empty table gives an empty result; further columns are ignored, or kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import bucket_bits, free, held, join_hot, n_words, ranked, running, table

SEED, MAX_EPOCHS = 29, 3.0
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)


def _keys() -> list[Column]:
    """The key of the source (s_null, s) and the document's place h, a number from 0 to 2**63 - 1, in the seeded order."""
    return [F.col("source").isNull().alias("s_null"), F.coalesce(F.col("source"), F.lit("")).alias("s"), F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text")), 1).alias("h")]


def measured(docs: DataFrame) -> DataFrame:
    """(row, doc_id, s_null, s, size, h): one compact row a document."""
    s_null, s, h = _keys()
    return held(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", s_null, s, n_words(F.col("text")).alias("size"), h))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """(s_null, s, size) to one row a source: s_null, s, place, source_size, weight, target.  budget: words in all, by default the sum of the sizes."""
    per = sizes.groupBy("s_null", "s").agg(F.sum("size").alias("source_size"))
    per = ranked(per, [F.col("s_null").asc(), F.col("s").asc()], "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    per = held(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    whole, free = per.agg(F.sum("source_size"), F.sum("weight")).first()
    whole, level, clamped = float(budget if budget is not None else whole or 0), None, -1
    level = whole / free if free else 0.0
    while True:  # a round clamps more sources or is the last
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        n, used, free = per.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, max(level, (whole - (used or 0)) / free)
    return per.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level))).drop("cap")


def cuts(rows: DataFrame, per: DataFrame) -> DataFrame:
    """One row a source: s_null, s, source_size, target, whole (times that all its documents are taken) and cut: documents up to this (h, row) are taken once more."""
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("whole", F.floor(epochs)).withColumn("part", (epochs - F.col("whole")) * F.col("source_size"))
    joined = held(join_hot(rows.select("row", "s_null", "s", "size", "h"), per.select("s_null", "s", "place", "part"), ["s_null", "s"]))
    at = running(joined, ["place"], "h", "row", F.col("size"), "_at", bucket_bits(joined.count()))
    cut = at.where(F.col("_at") + F.col("size") / 2 < F.col("part")).groupBy("place").agg(F.max(F.struct("h", "row")).alias("cut"))
    none = F.struct(F.lit(-1).cast("long").alias("h"), F.lit(-1).cast("long").alias("row"))
    return held(per.join(cut, "place", "left").select("s_null", "s", "source_size", "target", "whole", F.coalesce("cut", none).alias("cut")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, times (how often the document is taken) and taken (its words times that), a row a document."""
    rows = measured(docs)
    times = (F.col("whole") + (F.struct("h", "row") <= F.col("cut")).cast("long")).cast("long")
    out = join_hot(rows, cuts(rows, targets(rows, weights, max_epochs)), ["s_null", "s"]).withColumn("times", times)
    return out.select("doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.  Texts are not shuffled while the planner may broadcast the sources."""
    rows = measured(docs)
    per = cuts(rows, targets(rows, weights, max_epochs))
    s_null, s, h, whole, cut, rest, most, times, order = free(docs, "_s_null", "_s", "_h", "_whole", "_cut", "_rest", "_most", "_times", "_order")
    # rows at the cut itself: how many there are, and how many of them are taken once more
    at = join_hot(rows, per.select("s_null", "s", F.col("cut.h").alias("h"), F.col("cut.row").alias("last")), ["s_null", "s", "h"])
    tied = held(at.groupBy("s_null", "s").agg(F.count("*").alias("n"), F.count_if(F.col("row") <= F.col("last")).alias("most")))
    apart = bool(tied.where("most < n").take(1))
    per = held(per.join(tied, ["s_null", "s"], "left").select("s_null", "s", "whole", "cut.h", F.coalesce("most", F.lit(0)), F.coalesce(F.col("most") < F.col("n"), F.lit(False))))
    own = join_hot(docs.withColumns(dict(zip((s_null, s, h), _keys(), strict=True))), per.toDF(s_null, s, whole, cut, most, rest), [s_null, s])
    more = F.col(h) <= F.col(cut)
    if apart:  # of rows alike, some are taken once more: they are numbered, whichever is which
        ties = held(own.where(F.col(rest) & (F.col(h) == F.col(cut))).withColumn(times, F.monotonically_increasing_id()).withColumn(order, F.shiftrightunsigned(F.xxhash64(F.lit(SEED), times), 1)))
        ties = running(ties, [s_null, s], order, times, F.lit(1), "_at", bucket_bits(ties.count()))
        ties = ties.withColumn(times, F.col(whole) + (F.col("_at") < F.col(most)).cast("long"))
        own = own.where(~(F.col(rest) & (F.col(h) == F.col(cut)))).withColumn(times, F.col(whole) + more.cast("long"))
        own = own.unionByName(ties.select(*own.columns))
    else:
        own = own.withColumn(times, F.col(whole) + more.cast("long"))
    return own.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")
