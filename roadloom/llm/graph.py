"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import drop, held, join_hot


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), of long ids, to (node, root) for every node of an edge; root is the component's smallest node.

    Alternating stars: each node ties its larger neighbours, then its smaller ones, to the smallest node that it sees, until the edges are stars around
    the roots.  Minima are pre-aggregated, and joins on a node deal a hub's edges to several tasks.  Nothing but a count and a sum reaches the driver.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = held(pairs), None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_hot(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_hot(large, least, ["u"])
        small = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        new = held(small)
        drop(pairs)
        pairs = new
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    stars = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots)
