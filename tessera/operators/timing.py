"""Robust ranges of measured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import first_k


def median(values: Column) -> Column:
    """Of a sorted array."""
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(values, low) + F.get(values, high)) / 2


def robust_range(df: DataFrame, key: str, value: str, order: list[str], last: int = 10, least: int = 3, factor: float = 3.0) -> DataFrame:
    """(key, median, low, high) of the ``last`` values without those over ``factor`` times the median of the others.

    Keys with fewer than ``least`` values give no row.  An array holds ``last``
    values at most.
    """
    kept = first_k(df, [key], [F.desc(c) for c in order], last)
    grouped = kept.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("_v")).where(F.size("_v") >= least)
    good = F.filter("_v", lambda x, i: x <= factor * median(F.concat(F.slice("_v", F.lit(1), i), F.slice("_v", i + 2, F.size("_v")))))
    grouped = grouped.withColumn("_g", good).where(F.size("_g") > 0)
    return grouped.select(key, F.round(median(F.col("_g")), 6).alias("median"), F.round(F.array_min("_g"), 6).alias("low"), F.round(F.array_max("_g"), 6).alias("high"))
