"""Node feature vectors of signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..functions import svtype as sv
from ..functions import tokens as tk
from .depth import contig_bounds, depth_bins, primary_intervals, with_local_depth

# Names and order of the node features; the last three exist in the 27-column layout only.
NODE_FEATURES = (
    "is_del", "is_ins", "is_dup", "is_inv", "is_tra",
    "log_span", "log_svlen", "log_support", "mapq_norm", "confidence",
    "src_cigar", "src_split", "src_clip", "has_seq", "inv_pp", "inv_mm",
    "tag_cigar", "tag_sa", "tag_sa_multi", "tag_sa_multi_ins", "tag_clip_left", "tag_clip_right",
    "log_depth", "vaf",
    "platform_ont", "platform_ccs", "platform_clr",
)
BASE_DIM = 24
FULL_DIM = 27


def with_guess(df: DataFrame) -> DataFrame:
    """Add ``guess``, the inferred type of every signature, unless it is there."""
    if "guess" in df.columns:
        return df
    legacy = F.col("type") if "type" in df.columns else None
    return df.withColumn("guess", sv.guess_svtype(
        F.col("svtype"), F.col("source"), F.col("svlen"), F.col("tstart"), F.col("tend"), F.col("sa_contigs"), legacy))


def _tag(*keys: str) -> str:
    """1 when the source tag mentions any of the keys (a key never spans two tokens)."""
    tag = "upper(coalesce(source, ''))"
    return f"double({' or '.join(f'contains({tag}, {chr(39)}{k}{chr(39)})' for k in keys)})"


def feature_expressions(columns: list[str]) -> dict[str, str]:
    """Name -> SQL expression of the 27 node features.

    Needs ``guess`` and ``platform_key``; ``local_depth`` counts as 0 and ``insert_seq`` as missing if the
    table lacks them.
    """
    present = set(columns)
    span = "(greatest(tstart, tend, least(tstart, tend) + 1) - least(tstart, tend))"
    support = "greatest(1, coalesce(support, 0), coalesce(num_splits, 0))"
    depth = "local_depth" if "local_depth" in present else "0D"
    strand = "trim(coalesce(strand, ''))"
    has_seq = "coalesce(length(insert_seq) > 0, false)" if "insert_seq" in present else "false"
    values = {f"is_{t.lower()}": f"double(guess = '{t}')" for t in sv.CANONICAL_TYPES}
    values |= {
        "log_span": f"log1p(double({span}))",
        "log_svlen": f"log1p(double(if(coalesce(svlen, 0) <> 0, abs(svlen), {span})))",
        "log_support": f"log1p(double({support}))",
        "mapq_norm": "greatest(0D, least(1D, coalesce(mapq, 0) / 60D))",
        "confidence": "greatest(0D, least(1D, double(coalesce(confidence, 0D))))",
        "src_cigar": _tag("CIGAR", "GAP"),
        "src_split": _tag("SA", "SPLIT"),
        "src_clip": _tag("CLIP"),
        "has_seq": f"double({has_seq})",
        "inv_pp": f"double({strand} = '++')",
        "inv_mm": f"double({strand} = '--')",
        "tag_cigar": _tag("CIGAR"),
        "tag_sa": _tag("SA_TAG"),
        "tag_sa_multi": _tag("SA_TAG_MULTI"),
        "tag_sa_multi_ins": _tag("SA_TAG_MULTI_INS"),
        "tag_clip_left": _tag("CLIP_LEFT", "CLIP_L"),
        "tag_clip_right": _tag("CLIP_RIGHT", "CLIP_R"),
        "log_depth": f"log1p(greatest(0D, {depth}))",
        "vaf": f"if({depth} > 0, least(2D, {support} / {depth}), 0D)",
    }
    return values | {f"platform_{p}": f"double(coalesce(platform_key = '{p}', false))" for p in ("ont", "ccs", "clr")}


def node_features(signatures: DataFrame, platform: str | None = None, feature_dim: int = FULL_DIM) -> DataFrame:
    """Add ``guess`` and ``feat``, the feature vector as one array of doubles."""
    if feature_dim not in (BASE_DIM, FULL_DIM):
        raise ValueError(f"feature_dim must be {BASE_DIM} or {FULL_DIM}, got {feature_dim}")
    df = with_guess(signatures)
    values = feature_expressions(df.columns)
    own = tk.normalize_platform(F.col("platform")) if "platform" in df.columns else F.lit(None).cast("string")
    key = F.coalesce(tk.normalize_platform(F.lit(platform)), own) if platform else own
    vector = F.expr("array(" + ", ".join(values[name] for name in NODE_FEATURES[:feature_dim]) + ")")
    return df.withColumn("platform_key", key).withColumn("feat", vector).drop("platform_key")


def build_features(signatures: DataFrame, alignments: DataFrame | None = None, contigs: DataFrame | None = None,
                   bin_size: int = 1000, platform: str | None = None, feature_dim: int = FULL_DIM,
                   track: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Node features with local depth from ``alignments``, or from a ready ``track`` and its regions.

    Depth is 0 without either.
    """
    if track is None and alignments is not None:
        regions = contig_bounds(signatures, bin_size, contigs)
        track = depth_bins(primary_intervals(alignments), regions, bin_size)
    df = signatures
    if track is not None:
        df = df.withColumn("center", iv.center(F.col("tstart"), F.col("tend")))
        df = with_local_depth(df, track, "center", bin_size, regions=regions)
    return node_features(df, platform, feature_dim)


def l2_normalise(vector: Column) -> Column:
    """Vector over its Euclidean norm (floored at 1e-12); the norm is bound once per row."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    bound = F.array(F.struct(vector.alias("v"), F.greatest(norm, F.lit(1e-12)).alias("n")))
    return F.element_at(F.transform(bound, lambda s: F.transform(s["v"], lambda x: x / s["n"])), 1)
