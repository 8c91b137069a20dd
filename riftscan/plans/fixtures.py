"""Deterministic views that shape the given tables like the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import cigar as cg

_EPOCH_MICROS = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream. A pattern names it, as a stream's path may be one file only if it is found by a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _events(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.expr(f"(unix_micros(cast(ts as timestamp)) - {_EPOCH_MICROS}) div 20000000").alias("p"),
        F.floor("value").alias("v"),
    )


def sig(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Signatures derived from ``events``; ``read`` is ``table`` or ``streamed``."""
    kind, k, v = F.col("event_type"), F.col("k"), F.col("v")
    return _events(spark, sf_dir, read).select(
        F.col("event_id").alias("sid"),
        F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("contig"),
        F.col("p").alias("tstart"),
        (F.col("p") + F.when(kind.isin("view", "error"), F.lit(1)).otherwise(F.greatest(F.lit(1), v))).alias("tend"),
        F.when(kind == "click", "DEL").when(kind == "view", "INS").when(kind == "purchase", "DUP")
        .when(kind == "signup", "INV").otherwise("TRA").alias("svtype"),
        F.when(kind == "error", F.lit(0)).otherwise(v).alias("svlen"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("qname"),
        (k % 61).alias("mapq"),
        F.when(kind == "signup", F.when(k % 2 == 0, "++").otherwise("--")).otherwise("+").alias("strand"),
        F.when(k % 4 == 0, "CIGAR").when(k % 4 == 1, "SA_TAG").when(k % 4 == 2, "CIGAR|SA_TAG")
        .otherwise("CLIP_LEFT").alias("source"),
        F.lit(1).alias("num_splits"),
        ((k % 11) / 10.0).alias("confidence"),
        F.lit(1).alias("support"),
        F.when(kind == "error", F.array(F.concat(F.lit("chr"), ((F.col("user_id") + 1 + k % 4) % 5 + 1).cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("sa_contigs"),
    )


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments derived from ``events``; every third read takes its split evidence from the next event.

    The next event is found by an equi-join on event_id + 1 (ids are dense), not by a global window.
    """
    k, v, kind = F.col("k"), F.col("v"), F.col("event_type")
    base = _events(spark, sf_dir).select(
        "event_id", "k", "v", "p", "event_type",
        F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("ctg"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("st"),
        F.concat(
            (5 + k).cast("string"), F.lit("S"), (300 + k).cast("string"), F.lit("M"), (1 + v).cast("string"),
            F.when(kind == "click", "D").otherwise("I"), (200 + F.col("event_id") % 50).cast("string"), F.lit("M"),
            F.expr("cast(1 + v div 2 as string)"), F.when(kind == "purchase", "D").otherwise("I"), F.lit("100M"),
        ).alias("cigar"),
    )
    following = base.select(
        (F.col("event_id") - 1).alias("event_id"),
        F.concat_ws(",", "ctg", F.col("p").cast("string"), "st", "cigar", (k % 61).cast("string"), F.lit("0;")).alias("next_sa"),
    )
    joined = base.join(following, "event_id", "left")
    rows = joined.select(
        F.col("event_id").alias("sid"),
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("qname"),
        F.when(k % 13 == 0, F.lit(256)).when(k % 2 == 0, F.lit(0)).otherwise(F.lit(16)).alias("flag"),
        F.col("ctg").alias("contig"),
        F.col("p").alias("pos0"),
        (k % 61).alias("mapq"),
        "cigar",
        F.when(F.col("event_id") % 3 == 0, F.col("next_sa")).alias("sa"),
    )
    items = cg.cigar_items(F.col("cigar"))
    return (
        rows.withColumn("query_length", cg.query_span(items))
        .withColumn("ref_end", F.col("pos0") + cg.reference_span(items))
        .withColumn("seq", F.substring(F.repeat(F.concat(F.lit("ACGTTGCAAGTN"), F.col("qname")), 120),
                                       F.lit(1), F.col("query_length").cast("int")))
    )


def contigs(alignments: DataFrame) -> DataFrame:
    """Header table of the derived alignments: every contig as long as its last aligned base."""
    return alignments.groupBy("contig").agg(F.max("ref_end").alias("length"))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("chr"), (F.col("p_size") % 5 + 1).cast("string")).alias("contig"),
        (F.col("p_partkey") * 60).alias("start"),
        (F.col("p_partkey") * 60 + 20 + F.col("p_size")).alias("end"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("call_id"), F.col("quality").alias("y_true"),
        (((F.col("doc_id") * 37) % 101) / F.lit(100.0)).alias("prob"),
    )


def coverage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.element_at(F.array(F.lit("ont"), F.lit("ccs"), F.lit("clr")), F.col("c_nationkey") % 3 + 1).alias("platform"),
        F.round(F.abs("c_acctbal") / 200, 2).alias("coverage"),
    )
