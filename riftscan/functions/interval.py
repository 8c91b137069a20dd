"""Interval arithmetic on 0-based half-open coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_interval(start: Column, end: Column) -> Column:
    """Ordered, non-negative, non-empty interval as a struct (left, right); its span survives a shift."""
    left = F.least(start, end)
    right = F.greatest(F.greatest(start, end), left + 1)
    shift = F.greatest(-left, F.lit(0))
    return F.struct((left + shift).alias("left"), (right + shift).alias("right"))


def span(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), end - start)


def floor_div(value: Column, divisor) -> Column:
    """Flooring division (Spark's ``div`` truncates)."""
    return F.floor(value / divisor)


def center(start: Column, end: Column) -> Column:
    """Floor midpoint of the safe interval."""
    box = safe_interval(start, end)
    return floor_div(box["left"] + box["right"], 2)


def length_estimate(svlen: Column, start: Column, end: Column) -> Column:
    """|svlen| when it is set, else the width of the safe interval."""
    size = F.abs(F.coalesce(svlen, F.lit(0)))
    box = safe_interval(start, end)
    return F.when(size > 0, size).otherwise(box["right"] - box["left"])


def event_length(svlen: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.abs(F.coalesce(svlen, F.lit(0))), F.abs(end - start))


def support_value(support: Column, num_splits: Column, n_reads: Column | None = None) -> Column:
    """Evidence count of one signature: never below one."""
    parts = [F.coalesce(support, F.lit(0)), F.coalesce(num_splits, F.lit(0))]
    if n_reads is not None:
        parts.append(F.coalesce(n_reads, F.lit(0)))
    return F.greatest(F.lit(1), *parts)
