"""Signature tables, interval sets, labels, call features and manifests."""

from __future__ import annotations

import csv
import io
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import source_counts, type_counts
from ..operators.filters import normalise_signatures, with_unique_ids
from ..schemas import CALL_FEATURE_RECORD, SIGNATURES


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signatures from Parquet, ORC or JSON lines.

    Every table goes through the alias projection, which costs nothing and leaves no key NULL; records without
    an id of their own, or with one that others have too, are numbered.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".json", ".jsonl"):
        raw = spark.read.json(path)
    elif kind == ".orc":
        raw = spark.read.orc(path)
    else:
        raw = spark.read.parquet(path)
    return with_unique_ids(normalise_signatures(raw))


def write_signatures(df: DataFrame, path: str, params: dict | None = None) -> None:
    """Write a signature table, and beside it the counts per type and source and the parameters used."""
    native = normalise_signatures(df)
    native.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(SIGNATURES).parquet(path)
    counts = type_counts(stored).select(F.lit("svtype").alias("what"), F.col("svtype").alias("value"), "n").unionByName(
        source_counts(stored).select(F.lit("source").alias("what"), F.col("source").alias("value"), "n"))
    counts.withColumn("params", F.lit(json.dumps(params or {}, sort_keys=True, default=str))) \
        .write.mode("overwrite").json(path.rstrip("/") + ".counts")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (contig, start, end) of a plain or gzipped BED file; unusable lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)"))
    part = F.split(F.btrim("value"), r"\s+")
    rows = lines.select(F.get(part, F.lit(0)).alias("contig"),
                        F.get(part, F.lit(1)).try_cast("bigint").alias("start"),
                        F.get(part, F.lit(2)).try_cast("bigint").alias("end"))
    return rows.where(F.col("end") > F.col("start"))


def read_vcf_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct record ids of a VCF file; none for a missing file."""
    try:
        lines = spark.read.text(path)
    except Exception as error:  # an absent truth file means no labels of that kind
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "id string")
    part = F.split("value", "\t")
    ids = lines.where(~F.col("value").startswith("#")).select(F.get(part, F.lit(2)).alias("id"))
    return ids.where(~F.col("id").isin("", ".")).distinct()


def read_truth_labels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Ids of true-positive and false-positive calls of an evaluation folder."""
    tp, fp = read_vcf_ids(spark, f"{folder}/tp-call.vcf"), read_vcf_ids(spark, f"{folder}/fp.vcf")
    if tp.isEmpty() and fp.isEmpty():
        raise ValueError(f"no tp-call.vcf or fp.vcf labels in {folder}")
    return tp, fp


def read_call_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL_FEATURE_RECORD).json(path)


def read_manifest(spark: SparkSession, path: str) -> list[dict]:
    """Rows of a manifest: JSON (list, one object, or under sources, records or runs), JSON lines, CSV or TSV.

    A manifest lists inputs, each of which becomes a branch of the plan, so its rows belong on the driver.
    """
    path = os.path.expanduser(path)
    whole = spark.read.text(path, wholetext=True).first()
    text = whole[0].strip() if whole else ""
    if not text:
        raise ValueError(f"manifest is empty: {path}")
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".tsv", ".tab", ".csv"):
        return [dict(r) for r in csv.DictReader(io.StringIO(text), delimiter="," if suffix == ".csv" else "\t")]
    try:
        payload = json.loads(text)
    except json.JSONDecodeError:
        payload = [json.loads(line) for line in map(str.strip, text.splitlines()) if line and not line.startswith("#")]
    if isinstance(payload, dict):
        payload = next((payload[k] for k in ("sources", "records", "runs") if k in payload), [payload])
    for number, record in enumerate(payload, 1):
        if not isinstance(record, dict):
            raise TypeError(f"manifest record {number} is not an object")
    return [dict(record) for record in payload]


_PATH_FIELDS = ("data_path", "bam_path", "feature_bam_path", "save_signatures_path")


def read_source_manifest(spark: SparkSession, path: str) -> list[dict]:
    """Manifest rows that name a signature source each, with their paths expanded."""
    rows = []
    for number, record in enumerate(read_manifest(spark, path), 1):
        row = {k: os.path.expanduser(str(v)) if k in _PATH_FIELDS and v else v for k, v in record.items()}
        if not row.get("data_path") and not row.get("bam_path"):
            raise ValueError(f"manifest record {number} needs data_path or bam_path")
        rows.append(row)
    if not rows:
        raise ValueError(f"no usable records in manifest {path}")
    return rows


def first_path(row: dict, *names: str) -> str | None:
    """First non-empty of several path fields."""
    value = next((row[n] for n in names if row.get(n)), None)
    return os.path.expanduser(str(value)) if value else None


def split_name(row: dict) -> str:
    return str(row.get("split") or "train").strip().lower()


def number(row: dict, name: str, kind: type, default=None):
    """Numeric manifest field; empty and missing count as the default."""
    value = row.get(name, default)
    return default if value is None or value == "" else kind(value)
