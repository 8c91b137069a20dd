"""Pairwise similarity factors of two signatures, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors of the two similarity factors.
MIN_LENGTH_SIMILARITY = 0.20
MIN_POSITION_SIMILARITY = 0.10


def length_similarity(len_a: Column, len_b: Column) -> Column:
    a, b = F.greatest(F.lit(1), len_a), F.greatest(F.lit(1), len_b)
    return F.greatest(F.lit(MIN_LENGTH_SIMILARITY), F.sqrt(F.least(a, b) / F.greatest(a, b)))


def position_similarity(center_a: Column, center_b: Column, max_gap: int) -> Column:
    gap = F.abs(center_a - center_b)
    near = F.greatest(F.lit(MIN_POSITION_SIMILARITY), 1.0 - gap / F.lit(max(1.0, float(max_gap))))
    return F.when(gap > max_gap, F.lit(0.0)).otherwise(near)
