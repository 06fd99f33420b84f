"""Figures as texts for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(micros: Column) -> Column:
    """Microseconds in the unit that suits: below a millisecond whole, below a second with two places, else seconds with three."""
    return (
        F.when(micros < 1_000, F.concat(micros.cast("string"), F.lit(" µs")))
        .when(micros < 1_000_000, F.format_string("%.2f ms", micros / F.lit(1e3)))
        .otherwise(F.format_string("%.3f s", micros / F.lit(1e6)))
    )


def throughput(per_second: Column) -> Column:
    """Points a second, cut to a whole number, in groups of three digits."""
    return F.when(per_second == float("inf"), F.lit("∞ pts/s")).otherwise(F.concat(F.format_number(F.floor(per_second), 0), F.lit(" pts/s")))
