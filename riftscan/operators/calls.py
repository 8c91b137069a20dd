"""From clusters to calls: per-cluster aggregation, gates, geometry and score features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..functions import limits as lm
from ..functions.limits import CallParams

# Names and order of the score features of a call.
SCORE_FEATURES = (
    "log_support", "log_cluster_size", "support_ratio", "log_svlen", "log_span",
    "start_std", "end_std", "start_std_norm", "end_std_norm", "length_cv",
    "mean_cosine", "median_mapq", "prob_base",
    "split_fraction", "cigar_fraction", "source_diversity",
    "global_coverage", "log_global_coverage", "support_over_global_coverage",
    "coverage_low", "coverage_mid", "coverage_high",
    "platform_ont", "platform_ccs", "platform_clr",
    "strict_support_threshold", "support_margin_to_strict", "below_strict_support",
    "failed_compactness", "compactness_fail_count", "failed_mapq", "failed_start_std", "failed_end_std",
    "failed_length_cv", "failed_cosine",
    "is_del", "is_ins", "is_dup", "is_inv", "is_tra",
)
#: Digits that log gaps are rounded to before the largest one is picked.
_GAP_DIGITS = 9


def split_alleles(members: DataFrame, ratio_threshold: float, key: str = "cluster_id", length: str = "allele_len",
                  ident: str = "sid") -> DataFrame:
    """Add ``allele`` (0 or 1): clusters of four and more split at their largest gap of log lengths.

    All windows share the cluster key, so this costs no shuffle beyond the one the aggregation needs.
    """
    ordered = f"(partition by {key} order by {length}, {ident})"
    whole = f"(partition by {key})"
    marked = members.selectExpr(
        "*", f"row_number() over {ordered} as __rn", f"lag({length}) over {ordered} as __prev",
        f"count(1) over {whole} as __n", f"max({length}) over {whole} / min({length}) over {whole} as __spread")
    gaps = marked.selectExpr("*", f"round(log1p(double({length})) - log1p(double(__prev)), {_GAP_DIGITS}) as __gap")
    # First largest gap of the cluster: its place and the ratio of the two lengths around it.
    cut = gaps.selectExpr("*", f"max(struct(__gap, -__rn as at, {length} / greatest(1, __prev) as ratio)) over {whole} as __cut")
    wide = max(1.2, float(ratio_threshold) ** 0.5)
    allele = F.expr(f"if(__n >= 4 and __spread >= {float(ratio_threshold)}D and __cut.ratio >= {wide}D and __rn >= -__cut.at, 1, 0)")
    return cut.withColumn("allele", allele).select(*members.columns, "allele")


def _members(clusters: DataFrame, params: CallParams) -> DataFrame:
    """Cluster members with the call type, the per-record lengths and the allele number."""
    df = clusters.withColumns({
        "call_type": F.expr("if(bucket = 'UNK', 'INS', bucket)"),
        "allele_len": F.expr("greatest(1, abs(coalesce(svlen, 0)))"),
        "event_len": iv.event_length(F.col("svlen"), F.col("tstart"), F.col("tend")),
    })
    if not params.split_alleles:
        return df.withColumn("allele", F.lit(0))
    split = split_alleles(df, params.length_ratio_threshold)
    return split.withColumn("allele", F.when(F.col("call_type") == "TRA", 0).otherwise(F.col("allele")))


def most_common(values: Column) -> Column:
    """Most frequent string of an array, the least one among equals; NULL for an array without any.

    One fold over the sorted array: equal elements lie together, so each is counted in passing.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0)
    start = F.struct(none.alias("best"), zero.alias("n"), none.alias("here"), zero.alias("run"))

    def step(state: Column, value: Column) -> Column:
        run = F.when(state["here"] == value, state["run"] + 1).otherwise(1)
        more = run > state["n"]
        return F.struct(F.when(more, value).otherwise(state["best"]).alias("best"), F.when(more, run).otherwise(state["n"]).alias("n"),
                        value.alias("here"), run.alias("run"))

    return F.aggregate(F.array_sort(F.filter(values, lambda v: v.isNotNull())), start, step, lambda state: state["best"])


def cluster_summary(clusters: DataFrame, params: CallParams, dim: int) -> DataFrame:
    """One row per (cluster, allele): support, compactness metrics, medians, sources and partner.

    A cluster is never larger than a chunk, so the exact medians and the distinct sets stay bounded.
    """
    members = _members(clusters, params)
    name = F.nullif(F.btrim(F.coalesce("qname", F.lit(""))), F.lit(""))
    tag = F.upper(F.coalesce("source", F.lit("")))
    n = F.count(F.lit(1))
    centroid = F.expr("array(" + ", ".join(f"avg(emb[{i}])" for i in range(dim)) + ")")
    summary = members.groupBy("cluster_id", "allele").agg(
        F.first("contig").alias("contig"),
        F.first("call_type").alias("svtype"),
        n.alias("n"),
        F.size(F.collect_set(name)).alias("n_names"),
        F.sum(F.greatest(F.lit(1), F.coalesce("support", F.lit(1)))).alias("support_sum"),
        F.stddev_pop("tstart").alias("start_std"),
        F.stddev_pop("tend").alias("end_std"),
        F.stddev_pop("event_len").alias("__event_std"),
        F.median("event_len").alias("__event_median"),
        F.median(F.coalesce("mapq", F.lit(0))).alias("median_mapq"),
        F.median("tstart").cast("bigint").alias("start"),
        F.median("tend").cast("bigint").alias("end_median"),
        F.median("allele_len").cast("bigint").alias("len_median"),
        F.median("allele_len").alias("__len_scale"),
        F.stddev_pop("allele_len").alias("__len_std"),
        F.avg(F.when(tag.contains("SA") | tag.contains("SPLIT"), 1.0).otherwise(0.0)).alias("split_fraction"),
        F.avg(F.when(tag.contains("CIGAR"), 1.0).otherwise(0.0)).alias("cigar_fraction"),
        (F.size(F.collect_set(tag)) / n).alias("source_diversity"),
        F.flatten(F.collect_list("sa_contigs")).alias("__partners"),
        centroid.alias("__centroid"),
    )
    support = F.when(F.col("n_names") > 0, F.col("n_names")).otherwise(F.greatest(F.lit(1), F.col("support_sum")))
    spread = F.col("start_std") / 500.0 + F.col("__len_std") / (5.0 * F.greatest(F.lit(1.0), F.col("__len_scale")))
    score = 0.35 + F.least(F.lit(0.45), F.col("support") * 0.05) + F.greatest(F.lit(0.0), 0.2 - spread)
    # The members have length one, so their mean cosine to the centroid is the length of their mean.
    cosine = F.sqrt(F.aggregate("__centroid", F.lit(0.0), lambda acc, x: acc + x * x))
    return (
        summary
        .withColumn("support", support.cast("bigint"))
        .withColumn("length_cv", F.col("__event_std") / F.greatest(F.lit(1.0), F.col("__event_median")))
        .withColumn("mean_cosine", F.when(cosine <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), cosine)))
        .withColumn("base_prob", F.greatest(F.lit(0.01), F.least(F.lit(0.99), score)))
        .withColumn("partner_contig", F.when(F.col("svtype") == "TRA", most_common(F.col("__partners"))))
        .drop("__event_std", "__event_median", "__len_scale", "__len_std", "__partners", "__centroid",
              "n_names", "support_sum")
    )


def gated(summary: DataFrame, params: CallParams) -> DataFrame:
    """Add thresholds, ``failures``, ``passes`` and ``stat_keys`` (the counters the row contributes to)."""
    metrics = [F.col(c) for c in ("mean_cosine", "median_mapq", "start_std", "end_std", "length_cv")]
    strict = lm.strict_support(F.col("svtype"), params)
    df = (
        summary
        .withColumn("strict_threshold", strict)
        .withColumn("candidate_threshold",
                    lm.candidate_support(F.col("strict_threshold"), params.prefilter_mode, params.candidate_min_support))
        .withColumn("limits", lm.compactness_limits(F.col("svtype"), F.col("support"), params))
    )
    failures = (F.array().cast("array<string>") if params.disable_compactness_filter
                else lm.compactness_failures(F.col("limits"), *metrics))
    guard = lm.guard_failures(params, F.col("support"), metrics[0], metrics[2], metrics[3], metrics[4])
    df = df.withColumn("failures", failures).withColumn("guards", guard)
    enough = F.col("support") >= F.col("candidate_threshold")
    strict_met = F.col("support") >= F.col("strict_threshold")
    compact = F.size("failures") == 0
    guarded = F.size("guards") == 0
    kind = F.lower("svtype")

    def keys(name: str) -> Column:
        return F.array(F.lit(name), F.concat(F.lit(name + "_"), kind))

    def reasons(prefix: str, source: str) -> Column:
        return F.transform(source, lambda r: F.concat(F.lit(prefix), r))

    none = F.array().cast("array<string>")
    if params.prefilter_mode == "strict":
        passes = enough & strict_met & compact
        stats = (F.when(~enough | ~strict_met, keys("support"))
                 .when(~compact, F.concat(keys("compactness"), reasons("compactness_", "failures"))).otherwise(none))
    else:
        passes = enough & guarded
        rescued = F.concat(
            F.when(~strict_met, keys("rescued_below_strict_support")).otherwise(none),
            F.when(~compact, F.concat(keys("rescued_failed_compactness"),
                                      reasons("rescued_compactness_", "failures"))).otherwise(none))
        stats = (F.when(~enough, keys("support"))
                 .when(~guarded, F.concat(keys("prefilter_guard"), reasons("prefilter_guard_", "guards")))
                 .otherwise(rescued))
    return df.withColumn("strict_met", strict_met).withColumn("passes", passes).withColumn("stat_keys", stats)


def filter_stats(gates: DataFrame) -> DataFrame:
    """Counters (stat, n) of what the gates dropped or rescued; counted before the shuffle."""
    return gates.select(F.explode("stat_keys").alias("stat")).groupBy("stat").agg(F.count(F.lit(1)).alias("n"))


def reason_counts(gates: DataFrame) -> DataFrame:
    """Dropped and rescued rows by reason, and by reason and type: one aggregation with grouping sets."""
    rows = gates.select(F.lower("svtype").alias("svtype"), F.explode(F.array_union(
        F.col("failures"), F.when(F.col("passes"), F.array(F.lit("kept"))).otherwise(F.array(F.lit("dropped"))))).alias("reason"))
    return rows.groupingSets([[F.col("reason")], [F.col("reason"), F.col("svtype")]], "reason", "svtype").agg(
        F.count(F.lit(1)).alias("n"))


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Sum of several counter tables."""
    merged = stats[0]
    for extra in stats[1:]:
        merged = merged.unionByName(extra)
    return merged.groupBy("stat").agg(F.sum("n").alias("n"))


def call_geometry(passed: DataFrame, params: CallParams) -> DataFrame:
    """Final start, end, signed length and probability of the passing rows; short insertions drop out."""
    kind = F.col("svtype")
    point = kind.isin("INS", "TRA")
    length = F.when(kind == "TRA", F.lit(0)).when(kind == "INS", F.col("len_median")).otherwise(
        F.greatest(F.lit(int(params.min_svlen)), F.col("len_median")))
    end = F.when(point, F.col("start") + 1).when(
        F.col("end_median") <= F.col("start"), F.col("start") + F.greatest(F.lit(1), F.col("len_median"))
    ).otherwise(F.col("end_median"))
    return (
        passed.withColumn("end", end).withColumn("abs_len", length.cast("bigint"))
        .where((kind == "TRA") | (F.col("abs_len") >= int(params.min_svlen)))
        .withColumn("svlen", F.when(kind == "DEL", -F.col("abs_len")).otherwise(F.col("abs_len")))
        .withColumn("prob", F.greatest("base_prob", F.least(F.lit(0.99), F.col("mean_cosine"))))
        .drop("abs_len")
    )


def score_feature_values(params: CallParams) -> dict[str, Column]:
    """Name -> expression of the score features of a call row."""
    support, n = F.col("support"), F.greatest(F.lit(1), F.col("n"))
    event = F.when(F.col("svlen") != 0, F.abs("svlen")).otherwise(F.greatest(F.lit(1), F.abs(F.col("end") - F.col("start"))))
    cov = F.lit(params.global_coverage).cast("double")
    usable = cov.isNotNull() & ~F.isnan(cov) & (F.abs(cov) < lm.INF)
    positive = usable & (cov > 0)
    bucket = lm.coverage_bucket(cov)
    platform = F.lit((params.platform or "").strip().lower())

    def flag(condition: Column) -> Column:
        return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))

    values = {
        "log_support": F.log1p(F.greatest(F.lit(1), support).cast("double")),
        "log_cluster_size": F.log1p(n.cast("double")),
        "support_ratio": support / n,
        "log_svlen": F.log1p(event.cast("double")),
        "log_span": F.log1p(iv.span(F.col("start"), F.col("end")).cast("double")),
        "start_std_norm": F.col("start_std") / event,
        "end_std_norm": F.col("end_std") / event,
        "prob_base": F.col("prob"),
        "global_coverage": F.when(usable, cov).otherwise(F.lit(0.0)),
        "log_global_coverage": F.when(positive, F.log1p(cov)).otherwise(F.lit(0.0)),
        "support_over_global_coverage": F.when(positive, support / cov).otherwise(F.lit(0.0)),
        "strict_support_threshold": F.col("strict_threshold").cast("double"),
        "support_margin_to_strict": (support - F.col("strict_threshold")).cast("double"),
        "below_strict_support": flag(~F.col("strict_met")),
        "failed_compactness": flag(F.size("failures") > 0),
        "compactness_fail_count": F.size("failures").cast("double"),
    }
    values |= {c: F.col(c).cast("double") for c in (
        "start_std", "end_std", "length_cv", "mean_cosine", "median_mapq", "split_fraction", "cigar_fraction",
        "source_diversity")}
    values |= {f"coverage_{b}": flag(bucket == b) for b in ("low", "mid", "high")}
    values |= {f"platform_{p}": flag(platform == p) for p in ("ont", "ccs", "clr")}
    values |= {f"failed_{r}": flag(F.array_contains("failures", r)) for r in ("mapq", "start_std", "end_std", "length_cv", "cosine")}
    values |= {f"is_{t.lower()}": flag(F.col("svtype") == t) for t in ("DEL", "INS", "DUP", "INV", "TRA")}
    return {name: values[name] for name in SCORE_FEATURES}


def raw_calls(gates: DataFrame, params: CallParams) -> DataFrame:
    """Calls before deduplication, with their score features as a map."""
    placed = call_geometry(gates.where("passes"), params)
    values = score_feature_values(params)
    features = F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*values.values()))
    return placed.select(
        "cluster_id", "allele", "contig", "start", "end", "svtype", "svlen", "support", "prob",
        F.lit("PASS").alias("filter_status"), "partner_contig", features.alias("score_features"))


def rule_failures(calls: DataFrame, params: CallParams) -> DataFrame:
    """Add ``rule_ok``: strict support and every compactness limit hold for the call."""
    kind = F.upper(F.coalesce("svtype", F.lit("UNK")))
    values = [F.coalesce(F.col("score_features")[m], F.lit(0.0)) for m in
              ("mean_cosine", "median_mapq", "start_std", "end_std", "length_cv")]
    limits = lm.compactness_limits(kind, F.coalesce("support", F.lit(0)), params)
    broken = lm.compactness_failures(limits, *values)
    ok = (F.coalesce("support", F.lit(0)) >= lm.strict_support(kind, params)) & (F.size(broken) == 0)
    return calls.withColumn("rule_ok", ok)


def rule_postfilter(calls: DataFrame, params: CallParams) -> tuple[DataFrame, DataFrame]:
    """Calls that pass the rules, and counters of the dropped ones (total and per type)."""
    marked = rule_failures(calls, params)
    kept = marked.where("rule_ok").drop("rule_ok")
    return kept, drop_counters(marked.where(~F.col("rule_ok")), "rule_postfilter")


def drop_counters(dropped: DataFrame, name: str) -> DataFrame:
    keys = F.array(F.lit(name), F.concat(F.lit(name + "_"), F.lower(F.coalesce("svtype", F.lit("UNK")))))
    return dropped.select(F.explode(keys).alias("stat")).groupBy("stat").agg(F.count(F.lit(1)).alias("n"))
