"""VCF and call-feature output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import BLOCK_BP, ranked

# Header lines of the call file; every symbolic allele is a type in angle brackets.
HEADER = (
    "##fileformat=VCFv4.2",
    "##source=riftscan",
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End position">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="SV type">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="SV length">',
    '##INFO=<ID=SUPPORT,Number=1,Type=Integer,Description="Number of supporting signatures">',
    '##INFO=<ID=CHR2,Number=1,Type=String,Description="Partner chromosome for TRA">',
    '##INFO=<ID=CSCORE,Number=1,Type=Float,Description="Cluster scorer probability">',
    '##ALT=<ID=DEL,Description="Deletion">',
    '##ALT=<ID=INS,Description="Insertion">',
    '##ALT=<ID=DUP,Description="Duplication">',
    '##ALT=<ID=INV,Description="Inversion">',
    '##ALT=<ID=TRA,Description="Translocation">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
)
KNOWN_ALLELES = ("DEL", "INS", "DUP", "INV", "TRA")


def assign_call_ids(calls: DataFrame, order: list[str]) -> DataFrame:
    """Add ``call_no`` and ``call_id`` (call_1, call_2, ...) in the order (contig, start, type, partner, ``order``)."""
    numbered = ranked(calls, "call_no", [F.col("contig")], [F.floor(F.col("start") / BLOCK_BP)],
                      [F.col("start"), F.col("svtype"), F.coalesce("partner_contig", F.lit("")), *[F.col(c) for c in order]])
    if "call_id" in calls.columns:
        return numbered.withColumn("call_id", F.coalesce("call_id", F.concat(F.lit("call_"), F.col("call_no").cast("string"))))
    return numbered.withColumn("call_id", F.concat(F.lit("call_"), F.col("call_no").cast("string")))


def quality(prob: Column) -> Column:
    """Probability in percent, halves to even."""
    return F.bround(prob * 100).cast("bigint")


def vcf_lines(calls: DataFrame) -> DataFrame:
    """Add ``line``: the tab-separated record of every call. Starts are written without shifting."""
    kind = F.upper(F.coalesce("svtype", F.lit("INS")))
    pos = F.greatest(F.lit(1), F.col("start"))
    end = F.greatest(pos, F.col("end"))
    partner = F.nullif(F.col("partner_contig"), F.lit(""))
    score = F.col("scorer_prob") if "scorer_prob" in calls.columns else F.lit(None).cast("double")
    info = F.concat_ws(
        ";",
        F.concat(F.lit("END="), end.cast("string")), F.concat(F.lit("SVTYPE="), kind),
        F.concat(F.lit("SVLEN="), F.col("svlen").cast("string")), F.concat(F.lit("SUPPORT="), F.col("support").cast("string")),
        F.concat(F.lit("CHR2="), partner), F.when(score.isNotNull(), F.format_string("CSCORE=%.4f", score)))
    allele = F.when(kind.isin(*KNOWN_ALLELES), F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(F.lit("<SV>"))
    return calls.withColumn("line", F.concat_ws(
        "\t", F.coalesce("contig", F.lit("chrNA")), pos.cast("string"), F.col("call_id"), F.lit("N"), allele,
        quality(F.col("prob")).cast("string"), F.coalesce("filter_status", F.lit("PASS")), info))


def write_vcf(calls: DataFrame, path: str) -> None:
    """Write header and records as ordered text parts: the parts in name order are one VCF file."""
    spark = calls.sparkSession
    header = spark.createDataFrame([(-1, i, text) for i, text in enumerate(HEADER)], "section int, at bigint, line string")
    records = vcf_lines(calls).select(F.lit(0).alias("section"), F.col("call_no").cast("bigint").alias("at"), "line")
    header.unionByName(records).orderBy("section", "at").select("line").write.mode("overwrite").text(path)


def call_feature_records(calls: DataFrame, platform: str | None = None, global_coverage: float | None = None,
                         domain: str | None = None) -> DataFrame:
    """Call-feature records with their fields in alphabetical order, as JSON readers of the export expect."""
    values = {
        "call_id": F.col("call_id"), "contig": F.col("contig"), "domain": F.lit(domain).cast("string"),
        "end": F.coalesce("end", F.lit(0)), "global_coverage": F.lit(global_coverage).cast("double"),
        "platform": F.lit(platform).cast("string"), "prob": F.coalesce("prob", F.lit(0.0)),
        "score_features": F.map_from_entries(F.array_sort(F.map_entries("score_features"))),
        "start": F.coalesce("start", F.lit(0)), "support": F.coalesce("support", F.lit(0)),
        "svlen": F.coalesce("svlen", F.lit(0)), "svtype": F.col("svtype"),
    }
    return calls.select(*[values[name].alias(name) for name in sorted(values)])


def call_feature_lines(records: DataFrame) -> DataFrame:
    """One JSON object per record; missing values are written as null."""
    return records.select("call_id", F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("line"))


def write_call_features(calls: DataFrame, path: str, platform: str | None = None,
                        global_coverage: float | None = None, domain: str | None = None) -> None:
    records = call_feature_records(calls, platform, global_coverage, domain)
    call_feature_lines(records).select("line").write.mode("overwrite").text(path)
