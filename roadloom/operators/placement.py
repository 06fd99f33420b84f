"""Where vehicles' events and histories go: partitions, streams, fleets and stores."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import hashing

PARTITIONS = 1024


def stream_of(partition: Column, streams: int) -> Column:
    """The stream of a partition: equal blocks of partitions that follow each other, the last one shorter."""
    return F.floor(partition / F.lit(-(-PARTITIONS // streams)))


def stream_name(stream: Column) -> Column:
    return F.concat(F.lit("EVENTS-RAW-"), stream.cast("string"))


def subject(partition: Column) -> Column:
    return F.concat(F.lit("events.raw.p."), partition.cast("string"))


def parsed_range(text: str) -> tuple[int, int]:
    """first-last, both included, or one partition."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", text)
    if not m:
        raise ValueError(f"bad partitions {text!r}")
    first, last = int(m[1]), int(m[2] or m[1])
    if first > last or last >= PARTITIONS:
        raise ValueError(f"partitions {first} to {last} aren't in order and within 0..{PARTITIONS - 1}")
    return first, last


def fleet_slice(ordinal: Column, fleet: Column) -> list[Column]:
    """The first and last partition of a member of a fleet; the last member takes the rest."""
    chunk = F.floor(F.lit(PARTITIONS) / fleet)
    return [ordinal * chunk, F.when(ordinal == fleet - 1, F.lit(PARTITIONS - 1)).otherwise((ordinal + 1) * chunk - 1)]


def placed(keys: DataFrame, stores: DataFrame, key: str, name: str) -> DataFrame:
    """keys (key, h) and stores (store, seed) to the store of each key: the largest mixed hash of both as unsigned numbers, then the largest seed.  A fleet's
    stores are few: tasks hold their seeds and find the best within the row, so a key is never multiplied by them."""
    few = sorted({(r["seed"], r[name]) for r in stores.select("seed", name).collect()}, key=lambda r: r[0] % 2**64, reverse=True)
    if not few:
        return keys.limit(0).select(key, F.lit(None).cast(stores.schema[name].dataType).alias(name))
    seeds = np.array([seed for seed, _ in few], np.int64).astype(np.uint64)

    def best(h: pd.Series, known: pd.Series) -> pd.DataFrame:
        """The place of the best store, and its mixed hash with the sign bit turned, so that signed order is that of unsigned numbers."""
        known = known.to_numpy(bool)
        mixed = hashing.mixed(h.to_numpy(np.int64).astype(np.uint64)[:, None] ^ seeds)
        at = np.where(known, mixed.argmax(1), 0)  # the first of equals has the largest seed
        m = (mixed[np.arange(len(at)), at] ^ np.uint64(2**63)).astype(np.int64)
        return pd.DataFrame({"at": at.astype(np.int32), "m": pd.Series(m).where(known).astype("Int64")})

    # a column with nulls would come as doubles, which lose bits
    h = F.coalesce(F.col("h").cast("long"), F.lit(0).cast("long"))
    each = keys.select(key, F.pandas_udf(best, "at int, m bigint")(h, F.col("h").isNotNull()).alias("b"))
    # a key that comes with several hashes has one store: that of the largest mixed hash
    one = each.groupBy(key).agg(F.max(F.struct("b.m", (-F.col("b.at")).alias("at"))).alias("b"))
    names = F.array(*(F.lit(store) for _, store in few))
    return one.select(key, F.element_at(names, F.lit(1) - F.col("b.at")).cast(stores.schema[name].dataType).alias(name))
