"""Wrapping 64-bit hashes of vehicles and nodes, as Arrow-batched functions (signed columns hold the bit patterns)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
PARTITIONS = 1024
MASK = (1 << 64) - 1


def _fnv1a(text: pd.Series) -> pd.Series:
    def one(t: str | None):
        if t is None:
            return None
        h = FNV_OFFSET
        for b in t.encode():
            h = (h ^ b) * FNV_PRIME & MASK
        return h - (1 << 64) if h >> 63 else h

    return text.map(one, na_action="ignore").astype("Int64")


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _mix(values: pd.Series) -> pd.Series:
    x = mixed(values.fillna(0).to_numpy(np.int64).astype(np.uint64))
    return pd.Series(x.astype(np.int64)).where(values.notna().to_numpy()).astype("Int64")


def fnv1a64(text: Column) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return _fnv1a(text)

    return F.pandas_udf(run, LongType())(text)


def mix64(value: Column) -> Column:
    def run(value: pd.Series) -> pd.Series:
        return _mix(value)

    return F.pandas_udf(run, LongType())(value)


def vehicle_partition(vehicle: Column) -> Column:
    """The last bits of the mixed id: the remainder of the unsigned value."""
    return mix64(vehicle).bitwiseAND(F.lit(PARTITIONS - 1)).cast("int")
