"""From alignments to signatures: CIGAR evidence, split-read evidence, geometry and ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions.svtype import labelled_svtype
from ..session import materialise
from .features import with_guess
from .filters import eligible_reads
from .prefix import BLOCK_BP, ranked
from .split_reads import split_candidates

#: Evidence classes in the order their signatures are numbered.
EVIDENCE_ORDER = (("CIGAR", "DEL"), ("CIGAR", "INS"), ("SA_TAG", "DEL"), ("SA_TAG", "INS"), ("SA_TAG", "DUP"),
                  ("SA_TAG", "INV"), ("SA_TAG", "TRA"))


@dataclass(frozen=True)
class ExtractParams:
    min_sv_size: int = 30
    max_sv_size: int = 100_000
    min_mapq: int = 20
    min_read_len: int = 500
    min_siglength: int = 30
    merge_del_threshold: int = 0
    merge_ins_threshold: int = 100
    max_split_parts: int = 7


def cigar_candidates(reads: DataFrame, params: ExtractParams, keep: tuple[str, ...] = ("sid", "qname")) -> DataFrame:
    """Insertions and deletions inside alignments, nearby ones of a read joined.

    Hits of a read are an array; walking and joining them are folds over it, without window or shuffle.
    """
    items = cg.cigar_items(F.col("cigar"))
    good = reads.where(F.col("mapq") >= params.min_mapq).select(
        *keep, "contig", F.coalesce("seq", F.lit("")).alias("seq"),
        cg.indel_hits(items, F.col("pos0"), params.min_siglength).alias("hits"))

    def of(op: str) -> Column:
        return F.transform(F.filter("hits", lambda h: h["op"] == op), lambda h: F.struct(
            h["pos"].alias("pos"), h["len"].alias("len"),
            (cg.slice_text(F.col("seq"), h["read_end"] - h["len"], h["read_end"]) if op == "I"
             else F.lit(None).cast("string")).alias("seq")))

    def tagged(kind: str, merged: Column) -> Column:
        return F.transform(merged, lambda h, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), h["pos"].cast("double").alias("a"), h["len"].alias("b"),
            h["seq"].alias("seq")))

    merged = F.concat(
        tagged("DEL", cg.merge_read_hits(of("D"), params.merge_del_threshold, from_end=True)),
        tagged("INS", cg.merge_read_hits(of("I"), params.merge_ins_threshold, from_end=False)))
    return good.select(*keep, "contig", F.inline(merged))


def candidate_geometry(candidates: DataFrame) -> DataFrame:
    """Add tstart, tend and svlen to candidates with kind, a and b."""
    kind = F.col("kind")
    start = F.col("a").cast("bigint")
    sized = kind.isin("DUP", "INV")
    end = F.when(kind == "DEL", start + F.col("b")).when(kind.isin("INS", "TRA"), start + 1).otherwise(F.col("b"))
    length = F.when(kind == "TRA", F.lit(0)).when(sized, F.col("b") - start).otherwise(F.col("b"))
    return candidates.withColumn("tstart", start).withColumn("tend", end).withColumn("svlen", length.cast("bigint"))


def candidates(reads: DataFrame, params: ExtractParams, keep: tuple[str, ...] = ("sid", "qname")) -> DataFrame:
    """All candidates of eligible reads with their evidence source."""
    text = F.lit(None).cast("string")
    inside = cigar_candidates(reads, params, keep).select(
        *keep, F.lit("CIGAR").alias("source"), F.lit(0).alias("rule"), "at", "kind", "contig", "a", "b", "seq",
        text.alias("strand"), text.alias("partner"))
    split = split_candidates(reads, params.min_sv_size, params.max_sv_size, params.min_mapq, params.max_split_parts, keep)
    return inside.unionByName(split.withColumn("source", F.lit("SA_TAG")).drop("mode"))


def extract_signatures(alignments: DataFrame, params: ExtractParams = ExtractParams(),
                       region_start: int | None = None) -> DataFrame:
    """Signatures of the eligible reads of an ``alignments`` table, numbered from 0.

    Numbering follows evidence class, contig, position block and a hash of the read name, so it does not depend on the
    order tasks finish in. Every signature carries the quality threshold as its mapq: what matters
    later is that it passed.
    """
    reads = eligible_reads(alignments, params.min_read_len, region_start)
    found = candidate_geometry(candidates(reads, params, ("qname", "flag", "pos0")))
    placed = F.least("tstart", "tend")
    end = F.greatest(F.greatest("tstart", "tend"), placed + 1)
    rows = found.select(
        "contig", placed.alias("tstart"), end.alias("tend"), F.col("kind").alias("svtype"), "svlen", "qname",
        F.lit(int(params.min_mapq)).alias("mapq"),
        F.when(F.col("kind") == "INV", F.col("strand")).otherwise(F.lit("+")).alias("strand"),
        "source",
        F.when(F.col("kind") == "INS", F.col("seq")).alias("insert_seq"),
        F.lit(1).alias("num_splits"),
        F.when(F.col("kind") == "TRA", F.array("partner")).otherwise(F.array().cast("array<string>")).alias("sa_contigs"),
        F.lit(0.0).alias("svm_score"), F.lit(0.5).alias("confidence"), F.lit(1).alias("support"),
        F.lit(None).cast("string").alias("platform"),
        "flag", "pos0", "rule", "at",
    )
    evidence = F.lit(len(EVIDENCE_ORDER))
    for index, (source, kind) in reversed(list(enumerate(EVIDENCE_ORDER))):
        evidence = F.when((F.col("source") == source) & (F.col("svtype") == kind), F.lit(index)).otherwise(evidence)
    # Numbering reads its input twice; extraction is too dear for that.
    numbered = ranked(
        materialise(rows), "sid", [evidence, F.col("contig")],
        [F.floor(F.col("tstart") / BLOCK_BP), F.substring(F.md5("qname"), 1, 2)],
        [F.col("tstart"), F.col("tend"), F.col("qname"), F.col("pos0"), F.col("flag"), F.col("at"), F.col("rule")])
    return numbered.withColumn("sid", F.col("sid") - 1).drop("flag", "pos0", "rule", "at")


def type_counts(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("svtype").agg(F.count(F.lit(1)).alias("n"))


def source_counts(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def type_groups(signatures: DataFrame) -> DataFrame:
    """Signatures with ``kind``, their canonical type (the guess where there is no label at all)."""
    guessed = with_guess(signatures)
    return guessed.withColumn("kind", labelled_svtype(F.col("svtype"), F.col("guess"))).drop("guess")
