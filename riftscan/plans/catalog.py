"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import presets as ps
from ..functions import cigar as cg
from ..functions import interval as iv
from ..functions import limits as lm
from ..functions import similarity as sm
from ..functions import svtype as sv
from ..functions import tokens as tk
from ..functions.limits import CallParams
from ..models import objectives as ob
from ..models import scorer as sc
from ..models.encoder import embed, write_embeddings
from ..operators import bed as bd
from ..operators import call_pairs as cp
from ..operators import calls as ca
from ..operators import cluster as cl
from ..operators import contig_names as cn
from ..operators import dedup as dd
from ..operators import depth as dp
from ..operators import evaluate as ev
from ..operators import extract as ex
from ..operators import features as ft
from ..operators import filters as fl
from ..operators import split_reads as sr
from ..operators.prefix import block_neighbour
from ..schemas import CALL_FEATURE_RECORD
from ..sinks import calls as snk
from ..sources import tables as tb
from ..sources.bam import read_bam, write_bam
from ..streaming import ordered as so
from ..streaming import runs as sn
from . import fixtures as fx
from .inference import depth_track

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Graph and call parameters of the registered call queries: the 5x ONT anchor with a looser threshold,
#: so that the derived signatures form clusters of more than two members.
STRICT_GRAPH = ps.GraphParams(10, 0.84, 900)
CALL_GRAPH = ps.GraphParams(10, 0.60, 900)
CALL_PARAMS = CallParams(
    min_svlen=20, min_support=1, min_support_by_type={"DEL": 2, "INS": 2, "DUP": 2, "INV": 2, "TRA": 2},
    candidate_min_support=1, prefilter_mode="balanced", split_alleles=True, length_ratio_threshold=1.5,
    min_cluster_median_mapq=0.0, compactness_start_scale=1.35, compactness_end_scale=1.35,
    compactness_length_cv_scale=1.25, compactness_cosine_relax=0.04, platform="ont", global_coverage=5.0)
STRICT_PARAMS = CallParams(
    min_support_by_type={"DEL": 3, "INS": 3, "DUP": 3, "INV": 3, "TRA": 2}, min_cluster_median_mapq=20.0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def as_int(condition: Column | str) -> Column:
    return F.when(F.col(condition) if isinstance(condition, str) else condition, 1).otherwise(0)


# ---------------------------------------------------------------- filters and scalar functions

@query
def region_filter(spark, d):
    return fl.region_filter(fx.sig(spark, d), "chr1, chr3,", 10_000, 90_000).select("sid", "contig", "tstart", "tend")


@query
def property_filter(spark, d):
    return fl.property_filter(fx.sig(spark, d), 30, 100_000, 20).select("sid", "svtype", "svlen", "mapq")


@query
def unique_ids(spark, d):
    """Signatures whose ids repeat on every contig, and some without one, after they were numbered."""
    repeated = fx.sig(spark, d).withColumn("sid", F.when(F.col("sid") % 7 != 0, F.col("sid") % 100))
    return fl.with_unique_ids(repeated).groupBy("contig").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("sid").alias("ids"), F.sum("tstart").alias("starts"))


@query
def read_eligibility(spark, d):
    return fl.eligible_reads(fx.aln(spark, d), 600, 1_000).select("sid", "flag", "pos0", "query_length")


def _labelled(spark, d):
    """Signatures with labels in many spellings, some missing."""
    raw = F.array(*[F.lit(x) for x in ("dup:tandem", "BND", "Deletion", "foo_INS", "UNKNOWN", None, " inv ", "ctx",
                                        "TANDEM", "x:DUP", "INVx", "TRA_1")])
    return fx.sig(spark, d).withColumn("raw", F.when(F.col("sid") % 3 == 0, F.col("svtype")).otherwise(
        F.element_at(raw, (F.col("sid") % 12 + 1).cast("int"))))


@query
def normalize_svtype(spark, d):
    return _labelled(spark, d).select("sid", "raw", sv.normalize_svtype(F.col("raw")).alias("norm"))


def _unlabelled(spark, d):
    """Signatures whose label or source is of no use for part of the rows."""
    df = fx.sig(spark, d)
    return df.withColumn("svtype", F.when(F.col("sid") % 4 == 0, F.lit(None)).when(F.col("sid") % 4 == 1, F.lit("UNKNOWN"))
                         .when(F.col("sid") % 4 == 2, F.lit("")).otherwise(F.col("svtype"))) \
        .withColumn("source", F.when(F.col("sid") % 5 == 0, F.lit("x_bnd")).when(F.col("sid") % 5 == 1, F.lit("Dup|SA"))
                    .when(F.col("sid") % 5 == 2, F.lit("")).otherwise(F.col("source")))


@query
def guess_svtype(spark, d):
    return ft.with_guess(_unlabelled(spark, d)).select("sid", "svtype", "source", "guess")


@query
def type_bucket(spark, d):
    df = ft.with_guess(_unlabelled(spark, d))
    return df.select("sid", sv.type_bucket(F.col("svtype"), F.col("guess")).alias("bucket"),
                     sv.type_bucket(F.col("svtype"), F.col("guess"), True).alias("bucket_tra"))


@query
def svtype_ids(spark, d):
    df = ft.with_guess(_labelled(spark, d).withColumn("svtype", F.col("raw")))
    return df.groupBy(sv.svtype_id(F.col("svtype"), F.col("guess")).alias("svtype_id")).agg(F.count(F.lit(1)).alias("n"))


@query
def safe_interval(spark, d):
    df = fx.sig(spark, d).withColumn("s", F.col("tstart") - 2_000).withColumn(
        "e", F.col("tstart") - 2_000 + F.col("svlen") * F.when(F.col("sid") % 2 == 0, 1).otherwise(-1))
    return df.select("sid", F.inline(F.array(iv.safe_interval(F.col("s"), F.col("e"))))).withColumnsRenamed(
        {"left": "lo", "right": "hi"})


@query
def span_center_len(spark, d):
    s, e, n = F.col("tstart"), F.col("tend"), F.col("svlen")
    return fx.sig(spark, d).select("sid", iv.span(s, e).alias("span"), iv.center(s, e).alias("center"),
                                   iv.length_estimate(n, s, e).alias("len_est"), iv.event_length(n, s, e).alias("event_len"))


@query
def sig_support(spark, d):
    df = fx.sig(spark, d).withColumn("n_reads", (F.col("mapq") % 4))
    return df.select("sid", iv.support_value(F.col("sid") % 3, F.col("sid") % 7, F.col("n_reads")).alias("support"))


def _messy_source(spark, d):
    return fx.sig(spark, d).withColumn("source", F.when(F.col("sid") % 3 == 0, F.regexp_replace("source", r"\|", " ; "))
                                       .when(F.col("sid") % 3 == 1, F.lower("source"))
                                       .otherwise(F.concat("source", F.lit(",sa_tag_multi_ins"))))


@query
def source_tokens(spark, d):
    return _messy_source(spark, d).select("sid", F.array_join(tk.source_tokens(F.col("source")), "/").alias("tokens"),
                                          F.array_join(tk.pipe_tokens(F.col("source")), "/").alias("pipe_tokens"))


@query
def source_flags(spark, d):
    s = F.col("source")
    return _messy_source(spark, d).select(
        "sid", tk.mentions(s, "CIGAR", "GAP").alias("src_cigar"), tk.mentions(s, "SA", "SPLIT").alias("src_split"),
        tk.mentions(s, "CLIP").alias("src_clip"), tk.mentions(s, "SA_TAG_MULTI").alias("tag_multi"),
        tk.mentions(s, "CLIP_LEFT", "CLIP_L").alias("tag_left"))


@query
def platform_norm(spark, d):
    spelled = F.array(*[F.lit(x) for x in (" ONT ", "HiFi", "pacbio", "Nanopore", "", "illumina", "pacbio-hifi", None)])
    return fx.coverage_probe(spark, d).select(
        "id", tk.normalize_platform(F.element_at(spelled, (F.col("id") % 8 + 1).cast("int"))).alias("platform"))


@query
def coverage_bucket(spark, d):
    cov = F.when(F.col("id") % 10 == 0, F.lit(None).cast("double")).when(F.col("id") % 10 == 1, F.lit(0.0)).otherwise(F.col("coverage"))
    return fx.coverage_probe(spark, d).groupBy(lm.coverage_bucket(cov).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def coerce_signatures(spark, d):
    s = fx.sig(spark, d)
    kinds = F.array(*[F.lit(x) for x in ("UNCOVERED_gap", "soft_clip", "dup1", "xINVx", "bnd", "other")])
    raw = s.select("sid", F.col("contig").alias("chrom"), F.col("tend").alias("start"), F.col("tstart").alias("end"),
                   F.element_at(kinds, (F.col("sid") % 6 + 1).cast("int")).alias("type"), F.col("svlen").alias("SVLEN"),
                   F.col("qname").alias("read_name"), F.col("confidence").alias("prob"),
                   F.when(F.col("sid") % 2 == 0, F.lit(0)).otherwise(F.lit(3)).alias("SUPPORT"))
    return fl.normalise_signatures(raw).select("sid", "contig", "tstart", "tend", "svtype", "svlen", "qname", "mapq", "strand", "source",
                      "num_splits", r6("confidence").alias("confidence"), "support")


@query
def required_fields(spark, d):
    broken = fx.sig(spark, d).withColumn("mapq", F.when(F.col("sid") % 5 == 0, F.lit(None)).otherwise(F.col("mapq"))) \
        .withColumn("strand", F.when(F.col("sid") % 7 == 0, F.lit(None)).otherwise(F.col("strand")))
    return broken.groupBy(fl.missing_required(broken).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query
def contig_range_resolve(spark, d):
    specs = F.array(*[F.lit(x) for x in ("1-3", "chr2-chr4,chr2", "5", "X,chr1, ,chr1", "Chr4-5", " 3 , 2-1,4,1-2-3", "-1,2")])
    requests = fx.coverage_probe(spark, d).select("id", F.element_at(specs, (F.col("id") % 7 + 1).cast("int")).alias("spec"))
    return cn.resolve_contig_requests(requests, fx.sig(spark, d).select("contig").distinct())


@query
def contig_lengths(spark, d):
    names = fx.sig(spark, d).select(F.when(F.col("sid") % 4 == 0, F.concat("contig", F.lit("_alt"))).otherwise(F.col("contig")).alias("contig"), "sid")
    return cn.contig_lengths(names, fx.contigs(fx.aln(spark, d))).select("sid", "contig", "length")


@query
def reverse_complement(spark, d):
    return fx.table(spark, d, "benchmark").select("item_id", cg.reverse_complement(F.col("text")).alias("rc"))


# ---------------------------------------------------------------- alignments

@query
def cigar_parse(spark, d):
    return fx.aln(spark, d).select("sid", F.posexplode(cg.cigar_items(F.col("cigar"))).alias("idx", "item")).select(
        "sid", "idx", F.col("item.len").alias("n"), F.col("item.op").alias("op"))


@query
def cigar_clip_bias(spark, d):
    return fx.aln(spark, d).select("sid", F.inline(F.array(cg.clip_and_bias(F.col("cigar"))))).withColumnsRenamed(
        {"left": "clip_left", "right": "clip_right"})


@query
def cigar_indels(spark, d):
    hits = cg.indel_hits(cg.cigar_items(F.col("cigar")), F.col("pos0"), 30)
    return fx.aln(spark, d).select("sid", F.inline(hits)).withColumnRenamed("len", "n")


@query
def indel_merge(spark, d):
    params = ex.ExtractParams(min_mapq=0, merge_ins_threshold=300, merge_del_threshold=400)
    return ex.cigar_candidates(fx.aln(spark, d), params).select(
        "sid", "kind", F.col("at").alias("idx"), F.col("a").cast("bigint").alias("pos"), F.col("b").alias("n"), F.md5(F.coalesce("seq", F.lit("-"))).alias("seq_md5"))


@query
def sa_segments(spark, d):
    reads = sr.read_segments(fx.aln(spark, d), 20, 7)
    return reads.select("sid", F.posexplode("segments").alias("idx", "s")).select(
        "sid", "idx", "s.q0", "s.q1", "s.r0", "s.r1", "s.ctg", "s.st")


def _three_part(spark, d):
    """Derived alignments whose SA tag names two more segments, the second one on the read's own contig."""
    a = fx.aln(spark, d)
    other = F.concat_ws(",", "contig", (F.col("pos0") + 400 + F.col("sid") % 900).cast("string"),
                        F.when(F.col("sid") % 5 == 0, "-").otherwise("+"),
                        F.concat((300 + F.col("sid") % 400).cast("string"), F.lit("S200M50S")), F.lit("60"), F.lit("0;"))
    return a.withColumn("sa", F.when(F.col("sid") % 2 == 0, F.concat(F.coalesce("sa", F.lit("")), other)).otherwise(F.col("sa")))


@query
def split_read_calls(spark, d):
    return sr.split_candidates(_three_part(spark, d), 30, 100_000, 20, 7, ("sid",)).select(
        "sid", "mode", F.col("at").alias("idx"), "rule", "kind", "contig", "a", "b", F.md5(F.coalesce("seq", F.lit("-"))).alias("seq_md5"),
        "strand", "partner")


@query
def candidate_geometry(spark, d):
    found = ex.candidates(fl.eligible_reads(_three_part(spark, d), 500), ex.ExtractParams(), ("sid",))
    return ex.candidate_geometry(found).select("sid", "source", "rule", F.col("at").alias("idx"), "kind", "contig", "tstart", "tend", "svlen")


@query
def extract_signatures(spark, d):
    return ex.extract_signatures(_three_part(spark, d)).select(
        "sid", "contig", "tstart", "tend", "svtype", "svlen", "qname", "mapq", "strand", "source",
        F.array_join("sa_contigs", ",").alias("partners"), F.md5(F.coalesce("insert_seq", F.lit("-"))).alias("seq_md5"))


@query
def flag_classes(spark, d):
    """Reads per flag class: 1 forward, 2 reverse, 3 and 4 supplementary, 0 anything else."""
    flag = F.when(F.col("sid") % 9 == 0, F.col("flag") + 2048).otherwise(F.col("flag"))
    return fx.aln(spark, d).groupBy(fl.flag_class(flag).alias("flag_class")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- depth, intervals, features

def _regions(spark, d, bin_size=1000):
    return dp.contig_bounds(fx.sig(spark, d), bin_size, fx.contigs(fx.aln(spark, d)))


def _track(spark, d, bin_size=1000):
    return dp.depth_bins(dp.primary_intervals(fx.aln(spark, d)), _regions(spark, d, bin_size), bin_size)


@query
def depth_bins(spark, d):
    return _track(spark, d).select("contig", "bin", "depth")


@query
def depth_from_intervals(spark, d):
    a = fx.aln(spark, d)
    spans = fx.sig(spark, d).select("contig", F.col("tstart").alias("start"), F.col("tend").alias("end"))
    return dp.depth_bins(spans, dp.whole_contigs(fx.contigs(a)), 500).select("contig", "bin", "depth")


@query
def named_intervals(spark, d):
    """Signature intervals under other column names; a fifth without contig, a seventh without an end."""
    raw = fx.sig(spark, d).select(F.when(F.col("sid") % 5 > 0, F.col("contig")).alias("rname"), F.col("tstart").alias("s"),
                                  F.when(F.col("sid") % 7 > 0, F.col("tend")).alias("e"))
    return dp.named_intervals(raw, "chr2").groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query
def depth_runs(spark, d):
    return dp.depth_runs(_track(spark, d, 100))


@query
def local_depth(spark, d):
    s = fx.sig(spark, d).withColumn("center", iv.center(F.col("tstart"), F.col("tend")))
    regions = _regions(spark, d)
    track = dp.depth_bins(dp.primary_intervals(fx.aln(spark, d)), regions)
    return dp.with_local_depth(s, track, "center", regions=regions).select("sid", r6("local_depth").alias("local_depth"))


@query
def contig_bounds(spark, d):
    return dp.contig_bounds(fx.sig(spark, d), 1000)


@query
def global_coverage(spark, d):
    a = fx.aln(spark, d)
    return dp.global_coverage(a, fx.contigs(a), ["sid"]).select(r6("coverage").alias("coverage"))


@query
def bed_merge(spark, d):
    return bd.merged_bed(fx.bed(spark, d))


@query
def bed_overlap_semi(spark, d):
    return bd.overlapping(fx.sig(spark, d), fx.bed(spark, d)).select("sid", "contig", "tstart", "tend")


@query
def bed_anti(spark, d):
    return bd.not_overlapping(fx.sig(spark, d), fx.bed(spark, d)).select("sid", "contig", "tstart", "tend")


@query
def node_features(spark, d):
    a = fx.aln(spark, d)
    df = ft.build_features(fx.sig(spark, d), a, fx.contigs(a), 1000, "hifi")
    return df.select("sid", *[r6(F.col("feat")[i]).alias(name) for i, name in enumerate(ft.NODE_FEATURES)])


@query
def zscore_stats(spark, d):
    stats = ev.feature_stats(ft.node_features(fx.sig(spark, d)))
    return stats.select("dim", r6("mean").alias("mean"), r6("scale").alias("scale"))


@query
def zscore_apply(spark, d):
    df = ft.node_features(fx.sig(spark, d))
    z = ev.standardise(df, ev.feature_stats(df))
    return z.select("sid", *[r6(F.col("z")[i]).alias(f"z_{ft.NODE_FEATURES[i]}") for i in range(5, 10)])


@query
def embedding_stats(spark, d):
    stats = ev.embedding_stats(fx.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("emb")), dim=64)
    return stats.select(*[r6(c).alias(c) for c in stats.columns])


# ---------------------------------------------------------------- presets

def _odd_coverage(spark, d):
    probe = fx.coverage_probe(spark, d)
    return probe.withColumn("coverage", F.when(F.col("id") % 20 == 0, F.lit(None)).when(F.col("id") % 20 == 1, F.lit(-1.0))
                            .when(F.col("id") % 20 == 2, F.lit(9.0)).otherwise(F.col("coverage")))


@query
def preset_nearest(spark, d):
    df = ps.with_anchors(_odd_coverage(spark, d))
    return df.select("id", "platform", r6("effective_coverage").alias("effective_coverage"),
                     F.col("nearest.coverage").alias("anchor"), "nearest.graph_variant", "nearest.k_neighbors",
                     "nearest.similarity_threshold", "nearest.max_position_gap")


@query
def preset_bracket(spark, d):
    df = ps.with_anchors(_odd_coverage(spark, d))
    return df.select("id", F.col("lower.coverage").alias("x0"), F.col("upper.coverage").alias("x1"))


@query
def preset_interp(spark, d):
    df = ps.resolve_presets(_odd_coverage(spark, d))
    return df.select("id", "preset_name", as_int(F.col("enable_rule_postfilter")).alias("rules"),
                     *[r6(c).alias(c) for c in ps.FLOAT_FIELDS], *ps.INT_FIELDS)


# ---------------------------------------------------------------- clustering

def _embedded(spark, d, params=STRICT_GRAPH, include_tra=False):
    """Partitioned signatures with the identity embedding: their feature vector over its length."""
    parts = cl.partition_by_position(cl.with_bucket(fx.sig(spark, d), include_tra), params)
    return embed(ft.node_features(parts)).drop("feat")


@query
def gap_partitions(spark, d):
    parts = cl.partition_by_position(cl.with_bucket(fx.sig(spark, d)), STRICT_GRAPH)
    return parts.select("sid", "contig", "bucket", "sess", "chunk")


@query
def gap_partitions_capped(spark, d):
    capped = ps.GraphParams(10, 0.84, 900, max_group_size=7)
    return cl.partition_by_position(cl.with_bucket(fx.sig(spark, d), True), capped).select("sid", "contig", "bucket", "sess", "chunk")


@query
def knn_topk(spark, d):
    return cl.knn_within(fx.table(spark, d, "embeddings"), "label", "vec_id", "embedding", 5).select("src", "dst", r6("cosine").alias("cosine"))


@query
def knn_symmetric(spark, d):
    return cl.knn_within(fx.table(spark, d, "embeddings"), "label", "vec_id", "embedding", 5, symmetric=True).select(
        "src", "dst", r6("cosine").alias("cosine"))


@query
def affinity_edges(spark, d):
    return cl.affinity_edges(_embedded(spark, d), STRICT_GRAPH).select(
        "contig", "bucket", "src", "dst", r6("cosine").alias("cosine"), r6("weight").alias("weight"))


@query
def threshold_edges(spark, d):
    edges = cl.affinity_edges(_embedded(spark, d), STRICT_GRAPH)
    return edges.where(F.col("weight") >= STRICT_GRAPH.similarity_threshold).select("src", "dst", r6("weight").alias("weight"))


@query
def pair_similarity(spark, d):
    """Similarity factors of every signature and its successor in its contig and bucket."""
    parts = cl.partition_by_position(cl.with_bucket(fx.sig(spark, d)), STRICT_GRAPH)
    w = Window.partitionBy("contig", "bucket", "sess", "chunk").orderBy("tstart", "sid")
    cols = parts.select("sid", F.col("source"), iv.center(F.col("tstart"), F.col("tend")).alias("c"), F.col("svlen").alias("n"),
                        F.lead("sid").over(w).alias("sid2"), F.lead("source").over(w).alias("source2"),
                        F.lead(iv.center(F.col("tstart"), F.col("tend"))).over(w).alias("c2"), F.lead("svlen").over(w).alias("n2"))
    return cols.where(F.col("sid2").isNotNull()).select(
        "sid", "sid2", r6(sm.position_similarity(F.col("c"), F.col("c2"), 900)).alias("position"),
        r6(sm.length_similarity(F.col("n"), F.col("n2"))).alias("length"),
        r6(tk.source_bonus(F.col("source"), F.col("source2"))).alias("source"))


@query
def connected_components(spark, d):
    return cl.clusters(_embedded(spark, d), STRICT_GRAPH).select("sid", "cluster_id", "n_members")


# ---------------------------------------------------------------- calls

def _clusters(spark, d):
    return cl.clusters(_embedded(spark, d, CALL_GRAPH, True).select(*cl.CALL_COLUMNS, "emb"), CALL_GRAPH)


def _summary(spark, d, params=CALL_PARAMS):
    return ca.cluster_summary(_clusters(spark, d), params, ft.FULL_DIM)


def _gates(spark, d, params=CALL_PARAMS):
    return ca.gated(_summary(spark, d, params), params)


_KEY = ["cluster_id", "allele"]


@query
def cluster_support(spark, d):
    return _summary(spark, d).select(*_KEY, "contig", "svtype", "n", "support")


@query
def cluster_support_unnamed(spark, d):
    """Support when no read names are known: the sum of the records' own support."""
    blank = _clusters(spark, d).withColumn("qname", F.lit(" ")).withColumn("support", (F.col("sid") % 3).cast("int"))
    return ca.cluster_summary(blank, CALL_PARAMS, ft.FULL_DIM).select(*_KEY, "support")


@query
def cluster_metrics(spark, d):
    s = _summary(spark, d)
    return s.select(*_KEY, "start", "end_median", "len_median",
                    *[r6(c).alias(c) for c in ("start_std", "end_std", "length_cv", "mean_cosine", "median_mapq")])


@query
def cluster_sources(spark, d):
    return _summary(spark, d).select(*_KEY, *[r6(c).alias(c) for c in ("split_fraction", "cigar_fraction", "source_diversity")])


@query
def partner_mode(spark, d):
    return _summary(spark, d).where("svtype = 'TRA'").select(*_KEY, "partner_contig")


@query
def allele_split(spark, d):
    members = _clusters(spark, d).withColumn("allele_len", F.greatest(F.lit(1), F.abs("svlen")))
    return ca.split_alleles(members, 1.5).select("sid", "cluster_id", "allele")


@query
def call_probability(spark, d):
    return _summary(spark, d).select(*_KEY, r6("base_prob").alias("base_prob"))


@query
def call_geometry(spark, d):
    g = ca.call_geometry(_gates(spark, d).where("passes"), CALL_PARAMS)
    return g.select(*_KEY, "contig", "start", "end", "svtype", "svlen", r6("prob").alias("prob"))


@query
def score_features(spark, d):
    calls = ca.raw_calls(_gates(spark, d), CALL_PARAMS)
    return calls.select(*_KEY, *[r6(F.col("score_features")[n]).alias(n) for n in ca.SCORE_FEATURES])


@query
def compactness_limits(spark, d):
    df = ca.gated(_summary(spark, d, STRICT_PARAMS), STRICT_PARAMS).select(*_KEY, "svtype", "support", "limits.*")
    return df.select(*_KEY, "svtype", "support", *[
        r6(F.when(F.col(c) < 1e300, F.col(c)).otherwise(-1.0)).alias(c)
        for c in ("max_start_std", "max_end_std", "max_length_cv", "min_cosine", "min_mapq")])


@query
def compactness_failures(spark, d):
    return _gates(spark, d, STRICT_PARAMS).select(*_KEY, F.array_join("failures", ",").alias("failures"))


@query
def prefilter_guard(spark, d):
    tight = CallParams(prefilter_mode="balanced", candidate_min_support=2, min_cluster_cosine=1.33, max_cluster_start_std=30.0,
                       max_cluster_end_std=40.0, max_cluster_length_cv=0.1)
    return _gates(spark, d, tight).select(*_KEY, F.array_join("guards", ",").alias("guards"))


@query
def support_gates(spark, d):
    s = _summary(spark, d)
    strict = lm.strict_support(F.col("svtype"), STRICT_PARAMS)
    return s.select(*_KEY, strict.alias("strict"), lm.candidate_support(strict, "balanced", 1).alias("balanced"),
                    lm.candidate_support(strict, "relaxed", 2).alias("relaxed"),
                    as_int(F.col("support") >= strict).alias("strict_met"))


@query
def filter_stats(spark, d):
    return ca.filter_stats(_gates(spark, d))


@query
def filter_stats_strict(spark, d):
    return ca.filter_stats(_gates(spark, d, STRICT_PARAMS))


@query
def reason_rollup(spark, d):
    return ca.reason_counts(_gates(spark, d, STRICT_PARAMS))


@query
def dedup_signatures(spark, d):
    return dd.dedup_signatures(fx.sig(spark, d), 50).select("sid", "contig", "svtype", "tstart", "svlen")


def _sig_calls(spark, d, read=fx.table):
    """Every signature as a call of its own, to exercise call deduplication on dense input."""
    return fx.sig(spark, d, read).select(
        F.col("sid").alias("cluster_id"), "contig", F.col("tstart").alias("start"), F.col("tend").alias("end"), "svtype",
        F.when(F.col("svtype") == "DEL", -F.col("svlen")).otherwise(F.col("svlen")).alias("svlen"),
        (F.col("mapq") % 5 + 1).cast("bigint").alias("support"), F.col("confidence").alias("prob"),
        F.try_element_at("sa_contigs", F.lit(1)).alias("partner_contig"))


@query
def dedup_calls(spark, d):
    return dd.deduplicate_calls(_sig_calls(spark, d), ["cluster_id"]).select(
        "cluster_id", "contig", "start", "end", "svtype", "svlen", "support", r6("prob").alias("prob"), "partner_contig")


@query
def merge_predicate(spark, d):
    """Merge decision for every call and its successor of the same contig, type and partner."""
    calls = _sig_calls(spark, d).withColumn("partner", F.coalesce("partner_contig", F.lit("")))
    calls = calls.withColumn("block", F.floor(F.col("start") / 4096)).withColumn("a", F.struct("start", "end", "svtype", "svlen"))
    pairs = block_neighbour(calls, ["contig", "svtype", "partner"], "block", ["start", "cluster_id"], F.struct("a", "cluster_id"), "next", ahead=True)
    pairs = pairs.where(F.col("next").isNotNull()).select(F.col("cluster_id").alias("id_a"), "a", F.col("next.a").alias("b"), F.col("next.cluster_id").alias("id_b"))
    return pairs.select("id_a", "id_b", as_int(dd.calls_should_merge("a", "b")).alias("merge"))


@query
def call_band_pairs(spark, d):
    """Every two geometries of calls within the window, once, with the merge decision."""
    pairs = cp.band_pairs(_sig_calls(spark, d), "cluster_id")
    return pairs.select("contig", "svtype", "id_a", "id_b", "gap", as_int("merge").alias("merge"), "copies_a", "copies_b")


def _final_calls(spark, d):
    return snk.assign_call_ids(dd.deduplicate_calls(ca.raw_calls(_gates(spark, d), CALL_PARAMS), _KEY), _KEY)


@query
def call_ids(spark, d):
    return _final_calls(spark, d).select(*_KEY, "call_id", "contig", "start", "end", "svtype", "svlen", "support")


@query
def vcf_lines(spark, d):
    calls = _sig_calls(spark, d).withColumn("filter_status", F.lit("PASS")).withColumn("prob", F.col("prob") + F.lit(0.025)) \
        .withColumn("scorer_prob", F.when(F.col("cluster_id") % 2 == 0, F.col("prob")))
    numbered = snk.assign_call_ids(calls, ["cluster_id"])
    return snk.vcf_lines(numbered).select("cluster_id", "line")


@query
def rule_postfilter(spark, d):
    rules = CallParams(min_support_by_type={"DEL": 2, "INS": 2, "DUP": 2, "INV": 2, "TRA": 2}, min_support=1,
                       min_cluster_median_mapq=0.0, compactness_start_scale=1.35, compactness_end_scale=1.35,
                       compactness_length_cv_scale=1.25, compactness_cosine_relax=0.04)
    calls = ca.raw_calls(_gates(spark, d), CALL_PARAMS)
    return ca.rule_failures(calls, rules).select(*_KEY, as_int(F.col("rule_ok")).alias("rule_ok"))


@query
def call_feature_export(spark, d):
    """Call-feature JSON lines, read back with the declared schema."""
    calls = ca.raw_calls(_gates(spark, d), CALL_PARAMS).withColumn("call_id", F.concat_ws("_", "cluster_id", "allele"))
    lines = snk.call_feature_lines(snk.call_feature_records(calls, "ont", 5.0, "sim"))
    back = lines.select(F.from_json("line", CALL_FEATURE_RECORD).alias("r"))
    return back.select("r.call_id", "r.platform", "r.domain", "r.contig", "r.start", "r.end", "r.svtype", "r.svlen", "r.support",
                       r6("r.prob").alias("prob"), F.size("r.score_features").alias("n_features"),
                       r6(F.col("r.score_features")["log_span"]).alias("log_span"))


# ---------------------------------------------------------------- evaluation

@query
def label_join(spark, d):
    labels = fx.table(spark, d, "labels")
    tp = labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    fp = labels.where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("id"))
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("call_id"), "n_chars")
    return ev.label_calls(docs, tp, fp)


@query
def confusion(spark, d):
    c = ev.confusion(fx.truth(spark, d), 0.5)
    return c.select("tp", "fp", "fn", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@query
def threshold_sweep(spark, d):
    c = ev.threshold_metrics(fx.truth(spark, d))
    return c.select(r6("threshold").alias("threshold"), "tp", "fp", "fn", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@query
def threshold_select(spark, d):
    c = ev.select_threshold(fx.truth(spark, d))
    return c.select(r6("threshold").alias("threshold"), "tp", "fp", "fn", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@query
def type_source_counts(spark, d):
    s = fx.sig(spark, d)
    types = ex.type_counts(s).select(F.lit("type").alias("what"), F.col("svtype").alias("value"), "n")
    return types.unionByName(ex.source_counts(s).select(F.lit("source").alias("what"), F.col("source").alias("value"), "n"))


@query
def type_groups(spark, d):
    groups = ex.type_groups(_unlabelled(spark, d)).groupBy("kind")
    return groups.agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("first_sid"), F.sum("svlen").alias("total_len"))


@query
def union_sources(spark, d):
    s = fx.sig(spark, d).select("sid", "contig", "svtype")
    tagged = s.where("mapq >= 20").withColumn("source_id", F.lit(0)).unionByName(s.where("mapq < 40").withColumn("source_id", F.lit(1)))
    return tagged.groupBy("source_id", "contig", "svtype").agg(F.count(F.lit(1)).alias("n"))


@query
def sample_k(spark, d):
    return ev.sample_records(fx.sig(spark, d), 500, "sid", 42).select("sid", "contig", "tstart")


# ---------------------------------------------------------------- models

def _labelled_documents(spark, d):
    """Documents as call records: two features from the text, domain and naming fields from its source."""
    docs = fx.table(spark, d, "documents")
    features = F.map_from_arrays(
        F.array(F.lit("log_span"), F.lit("length_cv"), F.lit("extra")),
        F.array(F.log1p(F.col("n_chars").cast("double")), F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 7 / 7.0), F.lit(1.0)))
    return docs.select(
        F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("Sim_")).otherwise(F.lit("d_")), F.col("doc_id").cast("string")).alias("call_id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(" REAL ")).when(F.col("doc_id") % 5 == 1, F.lit("other")).alias("domain"),
        F.col("source").alias("source_name"), features.alias("score_features"))


@query
def record_domain(spark, d):
    df = _labelled_documents(spark, d)
    return df.select("call_id", sc.record_domain(df).alias("domain"))


@query
def record_vectors(spark, d):
    names = ("log_span", "length_cv", "mean_cosine", "domain_real", "domain_sim")
    rows = sc.vectorise_records(_labelled_documents(spark, d), names)
    return rows.select("call_id", *[r6(F.col("x")[i]).alias(n) for i, n in enumerate(names)])


def _waves(rows: int, columns: int, salt: int) -> np.ndarray:
    """A fixed weight matrix by a rule that SQL can state as well."""
    return 0.35 * np.sin(0.7 * np.arange(rows)[:, None] + 1.3 * np.arange(columns)[None, :] + salt)


def _ripple(size: int, salt: int) -> np.ndarray:
    return 0.1 * np.cos(np.arange(size) + salt)


def _norms(prefix: str, size: int, salt: int) -> dict:
    return {f"{prefix}.gain": 1 + _ripple(size, salt), f"{prefix}.shift": _ripple(size, salt + 1)}


@query
def encoder_forward(spark, d):
    """Embeddings of all signatures by an encoder of fixed weights."""
    weights, previous = {}, ft.FULL_DIM
    for i, width in enumerate((64, 64)):
        weights |= {f"h{i}.w": _waves(width, previous, i), f"h{i}.b": _ripple(width, i), **_norms(f"h{i}", width, i)}
        previous = width
    weights |= {"out.w": _waves(32, previous, 2), "out.b": _ripple(32, 2)}
    df = embed(ft.node_features(fx.sig(spark, d)), weights)
    return df.select("sid", *[r6(F.col("emb")[i]).alias(f"e{i}") for i in range(32)])


def _scored(spark, d):
    n = len(sc.SCORER_FEATURES)
    weights, previous = {}, 1
    for i, width in enumerate((8, 16, 16)):
        weights |= {f"c{i}.w": _waves(width, previous * 3, i).reshape(width, previous, 3), f"c{i}.b": _ripple(width, i), **_norms(f"c{i}", width, i),
                    f"c{i}.mean": _ripple(width, i + 2), f"c{i}.var": 1 + _ripple(width, i + 3)}
        previous = width
    weights |= {"d0.w": _waves(16, 2 * previous, 3), "d0.b": _ripple(16, 3), "d1.w": _waves(1, 16, 4), "d1.b": _ripple(1, 4)}
    model = {"weights": weights, "mean": _ripple(n, 5).tolist(), "scale": (1 + _ripple(n, 6)).tolist(), "platform_thresholds": {"ont": 0.6}}
    calls = ca.raw_calls(_gates(spark, d), CALL_PARAMS).withColumn("domain", F.lit("real"))
    return sc.score_calls(calls, model), model


@query
def scorer_forward(spark, d):
    """Score of every call by a scorer of fixed weights, and its decision at the platform's threshold."""
    scored, model = _scored(spark, d)
    threshold, _ = sc.resolve_threshold(model, "ont")
    return scored.select(*_KEY, r6("scorer_prob").alias("scorer_prob"), r6("prob").alias("prob"),
                         as_int(F.col("scorer_prob") >= threshold).alias("kept"))


@query
def score_filter_stats(spark, d):
    """Counters of the calls that the score and the rules drop, merged."""
    scored, model = _scored(spark, d)
    kept, dropped = sc.score_filter(scored, sc.resolve_threshold(model, "ont")[0])
    _, by_rule = ca.rule_postfilter(kept, CALL_PARAMS)
    return ca.merge_stats(dropped, by_rule)


@query
def threshold_source(spark, d):
    """Which threshold decides, by what a run and its checkpoint say."""
    rows = []
    for override in (None, 0.1):
        for name, model in (("none", {}), ("own", {"threshold": 0.4}), ("platform", {"threshold": 0.4, "platform_thresholds": {"ont": 0.7}})):
            for platform in ("ont", "ccs"):
                value, source = sc.resolve_threshold(model, platform, override)
                rows.append((override is not None, name, platform, value, source))
    cases = spark.createDataFrame(rows, "overridden boolean, checkpoint string, platform string, threshold double, source string")
    calls = fx.sig(spark, d).select((F.col("sid") % 2 == 0).alias("overridden"), F.element_at(F.array(*map(F.lit, ("none", "own", "platform"))), (F.col("sid") % 3 + 1).cast("int")).alias("checkpoint"),
                                    F.when(F.col("sid") % 5 < 3, "ont").otherwise("ccs").alias("platform"), "confidence")
    return calls.join(cases, ["overridden", "checkpoint", "platform"]).groupBy("overridden", "checkpoint", "platform", "threshold", "source").agg(
        F.sum(as_int(F.col("confidence") >= F.col("threshold"))).alias("kept"))


# ---------------------------------------------------------------- objectives

def _views(spark, d):
    return ob.with_views(fx.table(spark, d, "embeddings").where("embedding is not null"), "vec_id", "embedding", 0.05, 0.2, 7)


@query
def augmented_views(spark, d):
    """Both views of every embedding, one row for each component."""
    each = _views(spark, d).select("vec_id", F.explode(F.array(F.struct(F.lit(1).alias("view"), F.col("view_1").alias("x")),
                                                                F.struct(F.lit(2).alias("view"), F.col("view_2").alias("x")))).alias("v"))
    return each.select("vec_id", "v.view", F.posexplode("v.x").alias("place", "value")).withColumn("value", r6("value"))


@query
def vicreg_terms(spark, d):
    """Invariance, variance and covariance of two views of the embeddings."""
    terms = ob.vicreg_terms(_views(spark, d), "view_1", "view_2", 64, 1.0, 25.0, 1.0)
    return terms.select("rows", *[r6(c).alias(c) for c in ("invariance", "variance", "covariance", "loss")])


@query
def type_cross_entropy(spark, d):
    """Cross entropy of logits taken from the embeddings, by class and in all."""
    rows = fx.table(spark, d, "embeddings").where("embedding is not null").select(
        F.transform(F.slice("embedding", 1, 5), lambda x: x * 4).alias("logits"),
        F.when(F.col("vec_id") % 11 == 0, -100).otherwise(F.pmod(F.col("label"), F.lit(5))).alias("y"))
    return ob.type_cross_entropy(rows, "logits", "y").select("label", "n", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"))


# ---------------------------------------------------------------- files

@query
def bam_round_trip(spark, d):
    """Alignments written as a folder of BAM files and read back: one region through the index, one contig by a pushed filter."""
    path, rows = sn.scratch(spark, "bam"), fx.aln(spark, d)
    contigs = sorted((r.contig, r.length) for r in fx.contigs(rows).collect())  # the header
    write_bam(rows, path, contigs)
    region = read_bam(spark, path, "chr2", 20_000, 60_000).withColumn("part", F.lit("region"))
    filtered = read_bam(spark, path).where("contig = 'chr4' and mapq > 10").withColumn("part", F.lit("contig"))
    return region.unionByName(filtered).select(
        "part", "qname", "flag", "contig", "pos0", "ref_end", "mapq", "cigar", "query_length", F.md5("seq").alias("seq_md5"), "sa")


@query
def signature_table_file(spark, d):
    """Signatures written as a table and read back; the counts beside it add up to the rows."""
    path = sn.scratch(spark, "signatures") + ".parquet"
    tb.write_signatures(fx.sig(spark, d), path, {"min_mapq": 0})
    counts = spark.read.json(path + ".counts").where("what = 'svtype'").agg(F.sum("n").alias("total"))
    back = tb.read_signatures(spark, path).crossJoin(F.broadcast(counts))  # one row
    return back.select("sid", "contig", "tstart", "tend", "svtype", "svlen", "qname", "mapq", "source", "support", "total")


@query
def bed_file(spark, d):
    """Intervals written as BED text among comments and broken lines, and read back."""
    path, rows = sn.scratch(spark, "bed"), fx.bed(spark, d)
    line = F.when(F.col("start") % 7 == 0, F.concat_ws(" ", "contig", "start", "end")).otherwise(F.concat_ws("\t", "contig", "start", "end", F.lit("name")))
    noise = spark.createDataFrame([("# comment",), ("track name=x",), ("browser position",), ("",), ("chr1\tx\t5",), ("chr1\t9\t9",)], "value string")
    rows.select(line.alias("value")).unionByName(noise).write.text(path)
    return tb.read_bed(spark, path)


@query
def vcf_file(spark, d):
    """Calls written as VCF and their ids read back, with the header's lines counted."""
    path = sn.scratch(spark, "vcf")
    calls = _sig_calls(spark, d).withColumn("filter_status", F.lit("PASS"))
    snk.write_vcf(snk.assign_call_ids(calls, ["cluster_id"]), path)
    return tb.read_vcf_ids(spark, path).groupBy(F.length("id").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query
def truth_label_files(spark, d):
    """True and false calls written as the two VCF files of an evaluation folder, read back as labels and joined to all calls."""
    folder = sn.scratch(spark, "evaluation")
    calls = _sig_calls(spark, d).select("*", F.col("cluster_id").alias("call_no"), F.concat(F.lit("sv"), "cluster_id").alias("call_id"), F.lit("PASS").alias("filter_status"))
    snk.write_vcf(calls.where("cluster_id % 3 = 0"), f"{folder}/tp-call.vcf")
    snk.write_vcf(calls.where("cluster_id % 3 = 1 or cluster_id % 6 = 0"), f"{folder}/fp.vcf")
    return ev.label_calls(calls, *tb.read_truth_labels(spark, folder)).select("call_id", "svtype", "svlen", "label")


@query
def embedding_file(spark, d):
    """Embeddings of all signatures written as a table and read back."""
    path = sn.scratch(spark, "embeddings") + ".parquet"
    write_embeddings(embed(ft.node_features(fx.sig(spark, d))), path)
    return spark.read.parquet(path).select("sid", *[r6(F.col("emb")[i]).alias(f"e{i}") for i in range(ft.FULL_DIM)])


@query
def depth_cache(spark, d):
    """Depth around the signatures from a BAM folder, read from the track that a first run left in the cache."""
    path, cache, rows, found = sn.scratch(spark, "bam"), sn.scratch(spark, "depth"), fx.aln(spark, d), fx.sig(spark, d)
    write_bam(rows, path, sorted((r.contig, r.length) for r in fx.contigs(rows).collect()))  # the header
    depth_track(spark, found, path, 1000, cache)
    return depth_track(spark, found, path, 1000, cache)[0].select("contig", "bin", "depth")


@query
def call_feature_file(spark, d):
    """Call features written as JSON lines and read back by their reader."""
    path = sn.scratch(spark, "call-features")
    calls = ca.raw_calls(_gates(spark, d), CALL_PARAMS).withColumn("call_id", F.concat_ws("_", "cluster_id", "allele"))
    snk.write_call_features(calls, path, "ont", 5.0, "sim")
    return tb.read_call_features(spark, path).select(
        "call_id", "platform", "domain", "contig", "start", "end", "svtype", "svlen", "support", r6("prob").alias("prob"),
        F.size("score_features").alias("n_features"), r6(F.col("score_features")["log_span"]).alias("log_span"))


@query
def manifest_rows(spark, d):
    """Manifests of the suppliers as JSON lines and as CSV, read back with splits and typed fields."""
    rows = fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("key"), F.concat(F.lit("/in/"), "s_suppkey", F.lit(".parquet")).alias("data_path"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(" VAL ")).when(F.col("s_suppkey") % 3 == 1, F.lit("")).alias("split"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("min_mapq")).coalesce(1)
    found = []
    for kind in ("jsonl", "csv"):
        path = f"{sn.scratch(spark, 'manifest')}.{kind}"
        if kind == "csv":
            rows.write.option("header", "true").option("emptyValue", "").csv(path)
        else:
            rows.write.json(path)
        found += [(kind, int(r["key"]), tb.split_name(r), tb.number(r, "min_mapq", int, -1), r["data_path"]) for r in tb.read_source_manifest(spark, path)]
    return spark.createDataFrame(found, "kind string, key long, split string, min_mapq long, data_path string")


# ---------------------------------------------------------------- streams

@query
def stream_gap_sessions(spark, d):
    """Gap sessions of the events as a stream, run to its end: the rows of ``gap_partitions``."""
    def located(read):
        return cl.with_bucket(fx.sig(spark, d, read)).select("contig", "bucket", "tstart", "sid")

    rows = located(fx.streamed)
    ends = located(fx.table).select("contig", "bucket").distinct().selectExpr("*", "cast(null as bigint) as tstart", "cast(null as bigint) as sid")
    found = sn.drain_to_end(rows, ends, lambda df: so.stream_gap_sessions(
        df, ["contig", "bucket"], "tstart", "sid", STRICT_GRAPH.max_position_gap, STRICT_GRAPH.max_group_size, 100_000), sn.scratch(spark, "sessions"))
    return found.select(F.col("ident").alias("sid"), "contig", "bucket", "sess", "chunk")


@query
def stream_dedup_calls(spark, d):
    """Calls deduplicated as a stream, run to its end: the rows of ``dedup_calls``."""
    calls = _sig_calls(spark, d, fx.streamed)
    ends = _sig_calls(spark, d).select("contig", "svtype", "partner_contig").distinct()
    ends = ends.select(*(F.col(c) if c in ends.columns else F.lit(None).cast(t).alias(c) for c, t in calls.dtypes))
    kept = sn.drain_to_end(calls, ends, lambda df: so.stream_deduplicated_calls(df, "cluster_id", 100_000), sn.scratch(spark, "calls"))
    return _sig_calls(spark, d).join(kept.select(F.col("ident").alias("cluster_id")), "cluster_id").select(
        "cluster_id", "contig", "start", "end", "svtype", "svlen", "support", r6("prob").alias("prob"), "partner_contig")
