"""Support thresholds and compactness limits of calls, as column expressions over type and support."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")

# Base limits per type as start std, end std, length cv, cosine, median mapq.
BASE_LIMITS = {
    "INS": (50.0, INF, 0.35, 0.84, 25.0),
    "DEL": (90.0, 140.0, 0.28, 0.87, 30.0),
    "DUP": (100.0, 150.0, 0.32, 0.85, 25.0),
    "INV": (140.0, 200.0, 0.40, 0.82, 20.0),
    "TRA": (200.0, INF, INF, 0.80, 20.0),
    "UNK": (90.0, 140.0, 0.35, 0.84, 25.0),
}
# Default parameters of call generation.
DEFAULT_MIN_SUPPORT = {"DEL": 20, "INS": 10, "DUP": 6, "INV": 6, "TRA": 6}


@dataclass(frozen=True)
class CallParams:
    """Parameters of call generation and of the rule filter."""

    min_svlen: int = 20
    min_support: int = 3
    min_support_by_type: dict = field(default_factory=lambda: dict(DEFAULT_MIN_SUPPORT))
    candidate_min_support: int = 1
    prefilter_mode: str = "strict"
    split_alleles: bool = False
    length_ratio_threshold: float = 1.5
    disable_compactness_filter: bool = False
    min_cluster_cosine: float = 0.75
    max_cluster_start_std: float = 220.0
    max_cluster_end_std: float = 320.0
    max_cluster_length_cv: float = 0.55
    min_cluster_median_mapq: float = 20.0
    compactness_start_scale: float = 1.0
    compactness_end_scale: float = 1.0
    compactness_length_cv_scale: float = 1.0
    compactness_cosine_relax: float = 0.0
    platform: str | None = None
    global_coverage: float | None = None


def by_type(svtype: Column, values: dict, default) -> Column:
    expr = F.lit(default)
    for name, value in reversed(list(values.items())):
        expr = F.when(svtype == name, F.lit(value)).otherwise(expr)
    return expr


def strict_support(svtype: Column, params: CallParams) -> Column:
    """Required support of a type; the general minimum for types without one of their own."""
    return by_type(svtype, {k: int(v) for k, v in params.min_support_by_type.items() if v is not None},
                   int(params.min_support))


def candidate_support(strict: Column, mode: str, floor: int = 1) -> Column:
    """Support a candidate needs to stay in, from its strict threshold and the prefilter mode."""
    if mode == "strict":
        return strict
    floor = max(1, int(floor))
    if mode == "balanced":
        half = F.greatest(F.lit(2), F.floor(strict / 2).cast("int"))
        return F.greatest(F.lit(floor), F.least(strict, half))
    return F.least(strict, F.lit(floor))


def _sql_double(value: float) -> str:
    return "double('infinity')" if value == INF else f"{value}D"


def compactness_limits(svtype: Column, support: Column, params: CallParams) -> Column:
    """Struct of the limits of a call; an infinite limit means that the check is off."""
    bonus = F.least(F.lit(5.0), F.log2(F.greatest(F.lit(2), support).cast("double")))

    table = F.expr("map(" + ", ".join(f"'{k}', array({', '.join(_sql_double(x) for x in v)})" for k, v in BASE_LIMITS.items()) + ")")
    row = F.coalesce(F.try_element_at(table, svtype), F.try_element_at(table, F.lit("UNK")))

    def base(index: int) -> Column:
        return row[index]

    start_scale = max(0.1, params.compactness_start_scale)
    end_scale = max(0.1, params.compactness_end_scale)
    cv_scale = max(0.1, params.compactness_length_cv_scale)
    relax = max(0.0, params.compactness_cosine_relax)
    wanted_mapq = float(params.min_cluster_median_mapq)
    end_limit = F.least(F.lit(float(params.max_cluster_end_std)), base(1) * end_scale + 15.0 * bonus)
    return F.struct(
        F.least(F.lit(float(params.max_cluster_start_std)), base(0) * start_scale + 10.0 * bonus).alias("max_start_std"),
        F.when(base(1) == INF, F.lit(INF)).otherwise(end_limit).alias("max_end_std"),
        F.least(F.lit(float(params.max_cluster_length_cv)), base(2) * cv_scale).alias("max_length_cv"),
        F.greatest(F.lit(float(params.min_cluster_cosine)),
                   F.greatest(F.lit(0.0), base(3) - relax) - 0.01 * bonus).alias("min_cosine"),
        (F.lit(0.0) if wanted_mapq <= 0.0 else F.greatest(F.lit(wanted_mapq), base(4))).alias("min_mapq"),
    )


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    hits = F.array(*[F.when(condition, F.lit(name)) for condition, name in checks])
    return F.filter(hits, lambda name: name.isNotNull())


def compactness_failures(limits: Column, cosine: Column, mapq: Column, start_std: Column, end_std: Column,
                         length_cv: Column) -> Column:
    """Names of the limits a call breaks, in a fixed order."""
    return _reasons([
        (cosine < limits["min_cosine"], "cosine"),
        ((limits["min_mapq"] > 0) & (mapq < limits["min_mapq"]), "mapq"),
        (start_std > limits["max_start_std"], "start_std"),
        (end_std > limits["max_end_std"], "end_std"),
        (length_cv > limits["max_length_cv"], "length_cv"),
    ])


def guard_failures(params: CallParams, support: Column, cosine: Column, start_std: Column, end_std: Column,
                   length_cv: Column) -> Column:
    """Names of the coarse guards a candidate breaks; none in strict mode, which has its own gates."""
    if params.prefilter_mode == "strict":
        return F.array().cast("array<string>")
    return _reasons([
        (support < max(1, int(params.candidate_min_support)), "candidate_support"),
        (cosine < max(0.10, params.min_cluster_cosine - 0.35), "guard_cosine"),
        (start_std > params.max_cluster_start_std * 4.0, "guard_start_std"),
        (end_std > params.max_cluster_end_std * 4.0, "guard_end_std"),
        (length_cv > params.max_cluster_length_cv * 3.0, "guard_length_cv"),
    ])


def coverage_bucket(coverage: Column) -> Column:
    value = coverage.cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < INF)
    return (F.when(~usable, "unknown").when(value < 12.0, "low").when(value < 30.0, "mid").otherwise("high"))
