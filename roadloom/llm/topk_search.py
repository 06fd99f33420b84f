"""Operator 9: exact top-k search by distributed histogram selection.

Vectors are gathered in blocks, and every block of queries meets every block of candidates.  Each pass scores everything anew (a matrix product) and
sends, for each query, a histogram of the scores within the range where its kth value must lie; only bins from the block's own kth value up can
matter, so a histogram has few entries.  Summed over all blocks, it gives a narrower range and how many scores lie above.  When the range is one value,
that is the kth score: a last pass sends what is above it, and of its ties at most k with the smallest ids.  Scores are integers, so sums are exact.

Defined cases: null vectors and those with a null or non-finite component take no part, nor do rows without an id; shorter vectors count as filled up
with zeros; repeated rows are queries and candidates of their own, and a query meets every row but itself (where rows have no numbers: but those of its
id); fewer candidates than k give all of them; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, held, lean, shuffle_partitions, table

K, BINS = 20, 512
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
BLOCK = "block bigint, n int, width int, ids binary, rows binary, data binary"


def _blocks(size: int):
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, ids, keys, rows = TaskContext.get().partitionId() << 24, [], [], []

        def out() -> pd.DataFrame:
            nonlocal number
            width = max(map(len, rows))
            data = np.zeros((len(rows), width), np.int64)
            for i, r in enumerate(rows):
                data[i, : len(r)] = r
            number += 1
            return pd.DataFrame({"block": [number - 1], "n": [len(rows)], "width": [width], "ids": [np.array(ids, np.int64).tobytes()], "rows": [np.array(keys, np.int64).tobytes()], "data": [data.tobytes()]})

        for frame in batches:
            for i, key, v in zip(frame["vec_id"], frame["row"], frame["v"], strict=True):
                ids.append(i)
                keys.append(key)
                rows.append(np.asarray(v, np.int64))
                if len(rows) == size:
                    yield out()
                    ids, keys, rows = [], [], []
        if rows:
            yield out()

    return gather


def _scores(q_data: bytes, q_n: int, q_width: int, c_data: bytes, c_n: int, c_width: int) -> np.ndarray:
    q, c = np.frombuffer(q_data, np.int64).reshape(q_n, q_width), np.frombuffer(c_data, np.int64).reshape(c_n, c_width)
    width = min(q_width, c_width)
    q, c = q[:, :width], c[:, :width]
    if width == 0:
        return np.zeros((q_n, c_n), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width < 2**53:  # products and sums are exact as doubles
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


NONE = np.iinfo(np.int64).min


def _scored(frame: pd.DataFrame):
    for r in frame.itertuples(index=False):
        queries, c_rows, c_ids = (np.frombuffer(x, np.int64) for x in (r.rows, r.c_rows, r.c_ids))
        s = _scores(r.data, r.n, r.width, r.c_data, r.c_n, r.c_width)
        yield r, queries, c_ids, s, queries[:, None] != c_rows[None, :]


def _histograms():
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r, queries, _, s, other in _scored(frame):
                low, high, need = np.frombuffer(r.low, np.int64), np.frombuffer(r.high, np.int64), np.frombuffer(r.need, np.int64)
                step = (high - low) // BINS + 1
                out = []
                for i in range(len(queries)):
                    own = s[i][other[i] & (s[i] >= low[i])]
                    own = own[own <= high[i]]
                    if len(own) > need[i]:  # what is below the block's own kth value can't be the kth of all
                        least = np.partition(own, len(own) - need[i])[len(own) - need[i]]
                        own = own[own >= low[i] + (least - low[i]) // step[i] * step[i]]
                    bins, n = np.unique((own - low[i]) // step[i], return_counts=True)
                    out.append((np.full(len(bins), queries[i]), bins, n))
                yield pd.DataFrame({"query": np.concatenate([x[0] for x in out]), "bin": np.concatenate([x[1] for x in out]), "n": np.concatenate([x[2] for x in out])})

    return count


def _above(k: int):
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r, queries, c_ids, s, other in _scored(frame):
                low, out = np.frombuffer(r.low, np.int64), []
                for i in range(len(queries)):
                    at = np.flatnonzero(other[i] & (s[i] >= low[i]))
                    at = at[np.lexsort((c_ids[at], -s[i][at]))][:k]
                    out.append((np.full(len(at), queries[i]), c_ids[at], s[i][at]))
                yield pd.DataFrame({"query": np.concatenate([x[0] for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    return choose


def _ranges(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Query blocks with the ranges of their queries: state has query, low, high and need (how many of the k lie in the range)."""
    rows = blocks.select("block", "rows")
    listed = rows.mapInPandas(lambda it: (pd.DataFrame({"block": r.block, "place": np.arange(len(q)), "query": q}) for f in it for r in f.itertuples() for q in [np.frombuffer(r.rows, np.int64)]), "block bigint, place int, query bigint")
    placed = listed.join(state, "query").select("block", "place", "low", "high", "need")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:  # at most QUERY_BLOCK rows
        frame = frame.sort_values("place")
        return pd.DataFrame({"block": frame["block"].iloc[:1], **{c: [frame[c].to_numpy(np.int64).tobytes()] for c in ("low", "high", "need")}})

    return blocks.join(placed.groupBy("block").applyInPandas(pack, "block bigint, low binary, high binary, need binary"), "block")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors and queries (vec_id, v array<bigint>, row bigint) to query_id, rank, vec_id, score.  row tells rows apart: equal ones are the same row, which a
    query doesn't meet.  Without such a column vec_id is it, and mustn't repeat among the queries."""
    spark = vectors.sparkSession
    scratch, parts = Scratch(spark, "topk"), shuffle_partitions(spark)
    vectors, queries = (x if "row" in x.columns else x.withColumn("row", F.col("vec_id")) for x in (vectors, queries))
    candidates = scratch.put(vectors.select("vec_id", "v", "row").mapInPandas(lean(_blocks(CANDIDATE_BLOCK)), BLOCK))
    asked = scratch.put(queries.select("vec_id", "v", "row").coalesce(max(1, parts // 4)).mapInPandas(lean(_blocks(QUERY_BLOCK)), BLOCK))
    n = candidates.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    groups = min(n, parts)
    c = candidates.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), F.col("n").alias("c_n"), F.col("width").alias("c_width"), F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"), F.col("data").alias("c_data"))

    def met(blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(c, "g").drop("g", "block")

    # no score is larger than the product of the longest vectors' lengths
    top = float(vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0.0)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x) * F.lit(top))
    bound = (F.ceil(F.least(length, F.lit(4e18))) + 1).cast("long")
    state = queries.select(F.col("row").alias("query"), bound.alias("high"))
    state = held(state.select("query", (-F.col("high")).alias("low"), "high", F.lit(k).cast("long").alias("need")))
    while state.where("low < high").take(1):
        histogram = met(_ranges(asked, state)).mapInPandas(lean(_histograms()), "query bigint, bin bigint, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query").orderBy(F.col("bin").desc()))
        kth = histogram.withColumn("upto", upto).join(state, "query").where("upto >= need").groupBy("query").agg(F.max(F.struct("bin", "n", "upto")).alias("at"))
        step = F.expr(f"(high - low) div {BINS} + 1")
        low = F.col("low") + F.col("at.bin") * step
        found = state.join(kth, "query", "left")
        # fewer than are needed: all scores of the range belong to the result
        state = held(
            found.select(
                "query", F.coalesce(low, F.col("low")).alias("low"), F.coalesce(F.least(low + step - 1, F.col("high")), F.col("low")).alias("high"),
                F.coalesce(F.col("need") - (F.col("at.upto") - F.col("at.n")), F.col("need")).alias("need"),
            )
        )
    best = met(_ranges(asked, state)).mapInPandas(lean(_above(k)), "query bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    best = best.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): components times 64, rounded down; rows that take no part are left out."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return embeddings.where(fine).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long")).alias("v"))


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = held(whole_vectors(table(spark, sf_dir, "embeddings")).withColumn("row", F.monotonically_increasing_id()))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
