"""Row filters on signatures and alignments, and record normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import svtype as sv
from ..schemas import REQUIRED_SIGNATURE_FIELDS, SIGNATURES
from ..session import materialise

#: Flag bits of reads that carry no evidence of their own: unmapped, secondary, supplementary.
IGNORED_FLAGS = 4 | 256 | 2048


# Classes of exact flag values; any other flag is class 0.
FLAG_CLASSES = {4: 0, 0: 1, 16: 2, 2048: 3, 2064: 4}


def flag_class(flag: Column) -> Column:
    """1 forward, 2 reverse, 3 and 4 supplementary forward and reverse, 0 for anything else."""
    expr = F.lit(0)
    for value, kind in FLAG_CLASSES.items():
        expr = F.when(flag == value, F.lit(kind)).otherwise(expr)
    return expr


def requested_contigs(chrom: str | None) -> list[str] | None:
    """Contig names of a comma-separated request; None when nothing is requested."""
    if chrom is None:
        return None
    return sorted({part.strip() for part in str(chrom).split(",") if part.strip()}) or None


def region_filter(df: DataFrame, chrom: str | None = None, start: int | None = None,
                  end: int | None = None) -> DataFrame:
    """Signatures on the requested contigs that overlap [start, end)."""
    wanted = requested_contigs(chrom)
    if wanted is not None:
        df = df.where(F.col("contig").isin(*wanted))
    if start is not None:
        df = df.where(F.col("tend") > int(start))
    if end is not None:
        df = df.where(F.col("tstart") < int(end))
    return df


def property_filter(df: DataFrame, min_sv_size: int | None = None, max_sv_size: int | None = None,
                    min_mapq: int | None = None) -> DataFrame:
    """Signatures of sufficient mapping quality and size; translocations have no size to test."""
    if min_mapq is not None:
        df = df.where(F.coalesce("mapq", F.lit(0)) >= int(min_mapq))
    size = F.greatest(F.lit(1), F.abs(F.coalesce("svlen", F.lit(0))), F.abs(F.col("tend") - F.col("tstart")))
    checks: list[Column] = []
    if min_sv_size is not None:
        checks.append(size >= int(min_sv_size))
    if max_sv_size is not None and int(max_sv_size) != -1:
        checks.append(size <= int(max_sv_size))
    if checks:
        is_tra = F.upper(F.coalesce("svtype", F.lit(""))) == "TRA"
        df = df.where(is_tra | reduce(lambda a, b: a & b, checks))
    return df


def eligible_reads(df: DataFrame, min_read_len: int = 500, region_start: int | None = None) -> DataFrame:
    """Primary mapped reads that are long enough, have a CIGAR and start inside the region."""
    df = df.where(
        (F.col("flag").bitwiseAND(IGNORED_FLAGS) == 0)
        & (F.col("query_length") >= int(min_read_len))
        & F.col("cigar").isNotNull() & ~F.col("cigar").isin("", "*")
    )
    return df if region_start is None else df.where(F.col("pos0") >= int(region_start))


def _first_present(df: DataFrame, names: tuple[str, ...], kind: str, default=None) -> Column:
    parts = [F.col(n).cast(kind) for n in names if n in df.columns]
    if default is not None:
        parts.append(F.lit(default).cast(kind))
    return F.coalesce(*parts) if parts else F.lit(None).cast(kind)


def normalise_signatures(df: DataFrame) -> DataFrame:
    """Project records of any accepted spelling onto the signature schema.

    Alias chains become ``coalesce``: a missing and a NULL value are the same thing in a table. Records
    that carry only a legacy kind get their type from it, ends are ordered and never empty, and counts
    have defaults.
    """
    names = set(df.columns)
    start = _first_present(df, ("tstart", "start", "pos"), "bigint", 0)
    end = F.coalesce(*[F.col(n).cast("bigint") for n in ("tend", "end") if n in names], start)
    left, right = F.least(start, end), F.greatest(start, end)
    svtype = _first_present(df, ("svtype",), "string")
    if "type" in names:
        kind = F.col("type").cast("string")
        svtype = F.coalesce(svtype, sv.legacy_kind_svtype(kind), kind)
    source_names = tuple(n for n in ("source", "SRC", "type") if n in names)
    values = {
        "sid": _first_present(df, ("sid",), "bigint", 0),
        "contig": _first_present(df, ("contig", "chrom", "CHROM"), "string", "NA"),
        "tstart": left,
        "tend": F.greatest(right, left + 1),
        "svtype": F.coalesce(svtype, F.lit("UNKNOWN")),
        "svlen": _first_present(df, ("svlen", "SVLEN"), "bigint", 0),
        "qname": _first_present(df, ("qname", "read_name"), "string", ""),
        "mapq": _first_present(df, ("mapq", "MAPQ"), "int", 0),
        "strand": _first_present(df, ("strand", "STRAND"), "string", "+"),
        "source": _first_present(df, source_names, "string", "UNKNOWN"),
        "insert_seq": _first_present(df, ("insert_seq", "ins_seq"), "string"),
        "num_splits": _first_present(df, ("num_splits", "NUM_SPLITS"), "int", 1),
        "confidence": _first_present(df, ("confidence", "prob", "PROB", "score"), "double", 0.5),
        "support": F.coalesce(F.nullif(_first_present(df, ("support", "SUPPORT"), "int"), F.lit(0)), F.lit(1)),
        "svm_score": _first_present(df, ("svm_score",), "double", 0.0),
        "platform": _first_present(df, ("platform",), "string"),
    }
    for field in SIGNATURES.fields:
        if field.name not in values:
            present = F.col(field.name).cast(field.dataType) if field.name in names else F.lit(None)
            values[field.name] = F.coalesce(present, F.array().cast(field.dataType))
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SIGNATURES.fields])


def missing_required(df: DataFrame) -> Column:
    """Count of required signature fields that are NULL in a row."""
    return reduce(lambda a, b: a + b,
                  [F.when(F.col(f).isNull(), 1).otherwise(0) for f in REQUIRED_SIGNATURE_FIELDS])


def with_unique_ids(df: DataFrame) -> DataFrame:
    """``df`` with ``sid`` numbering its rows, unless its ids are all there and all different.

    Neighbours, clusters and calls are told apart by these ids, so two records must never share one. New numbers are
    fixed in the shared folder: a task that runs again finds the same ones.
    """
    if df.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or sid is null").isEmpty():
        return df
    return materialise(df.withColumn("sid", F.monotonically_increasing_id()))
