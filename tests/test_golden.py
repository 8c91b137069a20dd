"""Hand-derived rows of the scalar functions and presets."""

import pytest
from pyspark.sql import functions as F

from riftscan.functions import cigar as cg
from riftscan.functions import interval as iv
from riftscan.functions import limits as lm
from riftscan.functions import similarity as sm
from riftscan.functions import svtype as sv
from riftscan.functions import tokens as tk
from riftscan.functions.limits import CallParams
from riftscan.operators import bed as bd
from riftscan.operators import calls as ca
from riftscan.operators import cluster as cl
from riftscan.operators import dedup as dd
from riftscan.operators import depth as dp
from riftscan.operators import evaluate as ev
from riftscan.operators import filters as fl
from riftscan.presets import GraphParams, select_preset
from riftscan.sinks.calls import quality, vcf_lines


def merges(kind, a, b):
    return bool(dd._mergeable(dd._Numbers, kind == "TRA", kind == "INS", a[0], a[1], max(a[2], 1), b[0], b[1], max(b[2], 1)))


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_svtype(spark):
    given = ["dup:tandem", "BND", "Deletion", "foo_INS", "UNKNOWN", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, s string")
    rows = df.select("i", sv.normalize_svtype(F.col("s")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == ["DUP", "TRA", "DEL", "INS", None, None]


@pytest.mark.parametrize("given, wanted", [((10, 5), (5, 10)), ((7, 7), (7, 8)), ((-3, 2), (0, 5))])
def test_safe_interval(spark, given, wanted):
    assert tuple(one(spark, iv.safe_interval(F.lit(given[0]), F.lit(given[1])))) == wanted


def test_cigar(spark):
    items = one(spark, cg.cigar_items(F.lit("5S10M3D2I20M")))
    assert [(i.len, i.op) for i in items] == [(5, "S"), (10, "M"), (3, "D"), (2, "I"), (20, "M")]
    assert tuple(one(spark, cg.clip_and_bias(F.lit("5S10M3D2I20M")))) == (5, 0, 33)
    assert one(spark, cg.reverse_complement(F.lit("ACGTNa"))) == "tNACGT"


def test_cigar_walk_with_hard_clip_and_skip(spark):
    hits = one(spark, cg.indel_hits(cg.cigar_items(F.lit("7H10M40I100N5M50D3P30I")), F.lit(1000), 30))
    assert [(h.op, h.pos, h.len, h.read_end) for h in hits] == [
        ("I", 1010, 40, 50), ("D", 1115, 50, 155), ("I", 1165, 30, 188)]


def test_read_hits_merge(spark):
    def merged(hits, distance, from_end):
        column = F.array(*[F.struct(F.lit(p).cast("bigint").alias("pos"), F.lit(n).cast("bigint").alias("len"), F.lit(s).alias("seq"))
                           for p, n, s in hits])
        return [(h.pos, h.len, h.seq) for h in one(spark, cg.merge_read_hits(column, distance, from_end))]

    assert merged([(100, 40, "A"), (180, 35, "B"), (400, 50, "C")], 100, False) == [(100, 75, "AB"), (400, 50, "C")]
    assert [h[:2] for h in merged([(100, 40, ""), (140, 30, ""), (300, 50, "")], 0, True)] == [(100, 70), (300, 50)]


@pytest.mark.parametrize("begin, end", [(2, 5), (-3, 6), (4, 2), (0, 99), (-99, 3), (3, -1), (7, 9)])
def test_text_slice(spark, begin, end):
    assert one(spark, cg.slice_text(F.lit("abcdef"), F.lit(begin), F.lit(end))) == "abcdef"[begin:end]


def test_similarities(spark):
    gaps = [one(spark, sm.position_similarity(F.lit(0), F.lit(g), 900)) for g in (0, 450, 900, 901)]
    assert gaps == pytest.approx([1.0, 0.5, 0.10, 0.0])
    assert [one(spark, sm.length_similarity(F.lit(100), F.lit(n))) for n in (25, 1)] == pytest.approx([0.5, 0.2])
    pairs = [("CIGAR", "CIGAR|SA_TAG"), ("A", "B"), ("", "A")]
    assert [one(spark, tk.source_bonus(F.lit(a), F.lit(b))) for a, b in pairs] == pytest.approx([1.10, 1.0, 1.0])


def test_depth(spark):
    reads = spark.createDataFrame([("c", 0, 1500), ("c", 1200, 3000)], "contig string, start bigint, end bigint")
    track = dp.depth_bins(reads, spark.createDataFrame([("c", 0, 5000)], "contig string, lo bigint, hi bigint"), 1000)
    assert [r.depth for r in track.orderBy("bin").collect()] == [1, 2, 1, 0, 0]
    at = spark.createDataFrame([("c", 2500), ("c", 99_000), ("x", 5)], "contig string, pos bigint")
    found = {(r.contig, r.pos): r.local_depth for r in dp.with_local_depth(at, track, "pos").collect()}
    assert found == {("c", 2500): 0.8, ("c", 99_000): 0.0, ("x", 5): 0.0}


def test_bed(spark):
    bed = spark.createDataFrame([("chr1", 1, 5), ("chr1", 5, 8), ("chr1", 10, 12), ("chr1", 4, 4)], "contig string, start bigint, end bigint")
    merged = {(r.contig, r.start, r.end) for r in bd.merged_bed(bed).collect()}
    assert merged == {(c, s, e) for c in ("chr1", "1") for s, e in ((1, 8), (10, 12))}
    assert bd.overlapping(bed, None).count() == 4


def test_gap_partition(spark):
    rows = spark.createDataFrame([(i, "c", p, p + 1, "DEL", 1, "s") for i, p in enumerate((0, 500, 1500, 1600))],
                                 "sid bigint, contig string, tstart bigint, tend bigint, svtype string, svlen bigint, source string")
    rows = rows.withColumn("sa_contigs", F.array().cast("array<string>"))
    parts = cl.partition_by_position(cl.with_bucket(rows), GraphParams(10, 0.84, 900)).orderBy("sid").collect()
    assert [r.sess for r in parts] == [0, 0, 1, 1]


def test_support_gates(spark):
    got = [one(spark, lm.candidate_support(F.lit(s), "balanced", 1)) for s in (1, 2, 3, 5, 7, 11)]
    assert got == [1, 2, 2, 2, 3, 5]


def test_call_probability_and_alleles(spark):
    rows = [(1, "c", 100, 150, 50, "a", 7, "DEL"), (2, "c", 110, 160, 50, "b", 7, "DEL")]
    df = spark.createDataFrame(rows, "sid bigint, contig string, tstart bigint, tend bigint, svlen bigint, qname string, cluster_id bigint, bucket string")
    df = (df.withColumn("mapq", F.lit(60)).withColumn("source", F.lit("CIGAR")).withColumn("support", F.lit(1))
          .withColumn("sa_contigs", F.array().cast("array<string>")).withColumn("emb", F.array(F.lit(1.0), F.lit(0.0))))
    row = ca.cluster_summary(df, CallParams(), 2).first()
    assert row.base_prob == pytest.approx(0.64) and row.support == 2 and row.mean_cosine == pytest.approx(1.0)
    lengths = spark.createDataFrame([(i, 1, n) for i, n in enumerate((50, 52, 200, 210))], "sid bigint, cluster_id bigint, allele_len bigint")
    split = ca.split_alleles(lengths, 1.5).orderBy("sid").collect()
    assert [r.allele for r in split] == [0, 0, 1, 1]


def test_compactness_limits(spark):
    limits = one(spark, lm.compactness_limits(F.lit("DEL"), F.lit(4), CallParams(min_cluster_median_mapq=0.0)))
    assert (limits.max_start_std, limits.max_end_std) == pytest.approx((110.0, 170.0))
    assert (limits.max_length_cv, limits.min_cosine, limits.min_mapq) == pytest.approx((0.28, 0.85, 0.0))


def test_coverage_bucket(spark):
    got = [one(spark, lm.coverage_bucket(F.lit(c).cast("double"))) for c in (None, 0.0, 11.99, 12.0, 30.0)]
    assert got == ["unknown", "unknown", "low", "mid", "high"]


@pytest.mark.parametrize("kind, a, b, wanted", [
    ("INS", (100, 101, 100), (240, 241, 90), True), ("DEL", (100, 300, 200), (420, 620, 200), False),
    ("TRA", (100, 101, 0), (1100, 1101, 0), True), ("DUP", (0, 1000, 1000), (350, 900, 600), True)])
def test_merge_rule(spark, kind, a, b, wanted):
    def call(values):
        return F.struct(F.lit(values[0]).alias("start"), F.lit(values[1]).alias("end"), F.lit(values[2]).alias("svlen"), F.lit(kind).alias("svtype"))
    df = spark.range(1).select(call(a).alias("a"), call(b).alias("b"))
    assert df.select(dd.calls_should_merge("a", "b").alias("m")).first().m is wanted
    assert merges(kind, a, b) is wanted


def test_vcf_rounding_and_position(spark):
    assert [one(spark, quality(F.lit(p))) for p in (0.125, 0.375)] == [12, 38]
    call = spark.createDataFrame([("c", 0, 0, "BND", 5, 1, 0.5, "PASS", None, "call_1")],
                                 "contig string, start bigint, end bigint, svtype string, svlen bigint, support bigint, prob double, "
                                 "filter_status string, partner_contig string, call_id string")
    assert vcf_lines(call).first().line == "c\t1\tcall_1\tN\t<SV>\t50\tPASS\tEND=1;SVTYPE=BND;SVLEN=5;SUPPORT=1"


def test_confusion(spark):
    df = spark.createDataFrame([(1, .9), (1, .4), (0, .8), (0, .1)], "y_true int, prob double")
    row = ev.confusion(df, 0.5).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall, row.f1) == (1, 1, 1, .5, .5, .5)


def test_property_filter_keeps_translocations(spark):
    df = spark.createDataFrame([("TRA", 0, 30, 5, 6), ("INS", 3, 30, 5, 6)], "svtype string, svlen int, mapq int, tstart int, tend int")
    assert [r.svtype for r in fl.property_filter(df, 30, 100_000, 20).collect()] == ["TRA"]
    assert fl.property_filter(df, 30, -1, 31).count() == 0


def test_presets(spark):
    five = select_preset(spark, "ont", 5.0)
    assert five.platform == "ont" and five.graph_variant == "merge_b"
    assert (five.graph.k_neighbors, five.graph.similarity_threshold, five.graph.max_position_gap) == (10, .84, 900)
    tie = select_preset(spark, "ont", 6.5)
    assert tie.name == "ont_cov6.5_graph5.0_merge_b"
    assert tie.postfilter.min_support_del == tie.postfilter.min_support_inv == 2
    assert tie.postfilter.cluster_scorer_threshold == pytest.approx(.97)
    nine = select_preset(spark, "ccs", 9.0)
    assert nine.graph_anchor_coverage == 8.0 and nine.postfilter.min_support_del == 2
    assert [select_preset(spark, p, None).requested_coverage for p in ("ccs", "ont", "clr")] == [18.0, 15.0, 12.0]
    assert select_preset(spark, "clr", 100).name == "clr_cov100.0_graph30.0_base_graph"
    with pytest.raises(ValueError):
        select_preset(spark, "other", 5.0)


def test_pinned_cluster_counts(spark):
    """Counts of the derived signatures at sf0.01 that were verified outside this code base."""
    import os

    from riftscan.operators import features as ft
    from riftscan.plans import fixtures as fx

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs sf0.01")
    df = ft.node_features(fx.sig(spark, folder)).withColumn("emb", ft.l2_normalise(F.slice("feat", 1, 16)))
    found = cl.clusters(df, GraphParams(10, 0.84, 900))
    row = found.agg(F.countDistinct("cluster_id").alias("c"), F.count("*").alias("n"), F.max("n_members").alias("m")).first()
    assert (row.c, row.n, row.m) == (239, 498, 4)
