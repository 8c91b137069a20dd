"""BAM reading, tables, manifests and sinks."""

import gzip
import json
import random
import re

import pytest
from bam_fixture import write_bam
from pyspark.sql import functions as F

from riftscan.functions import cigar as cg
from riftscan.operators.extract import ExtractParams, extract_signatures
from riftscan.plans import fixtures as fx
from riftscan.plans.inference import depth_track, load_alignments, load_signatures, manifest_features, resolved_contigs
from riftscan.sinks.calls import HEADER, assign_call_ids, write_call_features, write_vcf
from riftscan.models.encoder import embed
from riftscan.operators import cluster as cl
from riftscan.operators.features import node_features
from riftscan.presets import GraphParams
from riftscan.sources import bam, tables

CONTIGS = [("chr1", 150_000), ("chr2", 150_000), ("chr3", 150_000), ("chr4", 150_000), ("chr5", 150_000), ("empty", 10)]
FIELDS = ["qname", "flag", "contig", "pos0", "ref_end", "mapq", "cigar", "seq", "query_length", "sa"]


@pytest.fixture(scope="module")
def reads(spark, sf_dir):
    rows = [r.asDict() for r in fx.aln(spark, sf_dir).select(*FIELDS).orderBy("contig", "pos0", "qname").collect()]
    rng = random.Random(1)
    for row in rows:
        row["seq"] = "".join(rng.choice("ACGTN") for _ in range(row["query_length"]))
    return rows


@pytest.fixture(scope="module")
def bam_path(tmp_path_factory, reads):
    path = str(tmp_path_factory.mktemp("bam") / "sample.bam")
    extra = {"qname": "lost", "flag": 4, "contig": None, "pos0": -1, "ref_end": 0, "mapq": 0, "cigar": "", "seq": "ACGTA", "sa": None}
    write_bam(path, CONTIGS, [*reads, extra])
    return path


def as_tuples(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


def wanted(reads, keep=lambda r: True):
    return sorted(tuple(r[f] for f in FIELDS) for r in reads if keep(r))


@pytest.mark.parametrize("split", [1, 20_000, 1 << 26])
def test_bam_round_trip(spark, bam_path, reads, split):
    df = bam.read_bam(spark, bam_path, splitBytes=split)
    got = as_tuples(df.where("contig is not null"))
    assert got == wanted(reads)
    assert df.where("contig is null").count() == 1
    if split == 1:
        assert df.rdd.getNumPartitions() > 10


def test_bam_region_and_pushdown(spark, bam_path, reads):
    region = bam.read_bam(spark, bam_path, "chr2", 40_000, 60_000, splitBytes=1)
    assert as_tuples(region) == wanted(reads, lambda r: r["contig"] == "chr2" and r["pos0"] < 60_000 and r["ref_end"] > 40_000)
    filtered = bam.read_bam(spark, bam_path, splitBytes=1).where("contig = 'chr4' and mapq > 10")
    assert as_tuples(filtered) == wanted(reads, lambda r: r["contig"] == "chr4" and r["mapq"] > 10)
    assert bam.read_bam(spark, bam_path, "empty").count() == 0
    primary = [r for r in reads if not r["flag"] & 2308][:25]
    assert [r.qname for r in bam.read_bam(spark, bam_path, head=25).collect()] == [r["qname"] for r in primary]


def test_bam_header_and_index(spark, bam_path, reads, tmp_path):
    assert bam.bam_contigs(spark, bam_path).count() == len(CONTIGS)
    assert bam.bam_mapped_reads(spark, bam_path).first().n == len(reads)
    bare = tmp_path / "bare.bam"
    bare.write_bytes(open(bam_path, "rb").read())
    with pytest.raises(Exception, match="no index"):
        bam.read_bam(spark, str(bare)).count()


def test_extraction_from_bam_matches_the_table(spark, bam_path, reads):
    table = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in reads], bam.ALIGNMENTS)
    a = extract_signatures(bam.read_bam(spark, bam_path, splitBytes=5_000)).drop("sorted_aligns", "bkps")
    b = extract_signatures(table).drop("sorted_aligns", "bkps")
    assert a.count() > 100 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    ids = a.agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.countDistinct("sid").alias("n")).first()
    assert (ids.lo, ids.hi) == (0, ids.n - 1)
    inserted = a.where("svtype = 'INS' and source = 'CIGAR'").select("qname", "insert_seq", "svlen").first()
    read = next(r for r in reads if r["qname"] == inserted.qname)
    assert inserted.insert_seq in read["seq"] and len(inserted.insert_seq) == inserted.svlen


def test_load_and_save_signatures(spark, bam_path, tmp_path):
    path = str(tmp_path / "sigs.parquet")
    first = load_signatures(spark, bam_path=bam_path, save_path=path, chrom="2-3", params=ExtractParams(min_mapq=10))
    contigs = {r.contig for r in first.select("contig").distinct().collect()}
    assert contigs == {"chr2", "chr3"}
    again = load_signatures(spark, data_path=path, chrom="chr2,3", params=ExtractParams(min_mapq=10))
    assert first.count() == again.count() > 0
    counts = {(r.what, r.value): r.n for r in spark.read.json(path + ".counts").collect()}
    stored = spark.read.parquet(path)
    assert sum(n for (what, _), n in counts.items() if what == "svtype") == stored.count()
    with pytest.raises(ValueError):
        load_signatures(spark)
    with pytest.raises(ValueError):
        resolved_contigs(spark, "chrX", bam.bam_contigs(spark, bam_path))


def test_exact_region_keeps_reads_that_start_inside(spark, bam_path, reads):
    region = load_alignments(spark, bam_path, "1", 30_000, 90_000)
    assert as_tuples(region) == wanted(reads, lambda r: r["contig"] == "chr1" and r["pos0"] < 90_000 and r["ref_end"] > 30_000)


def test_legacy_records(spark, tmp_path):
    path = tmp_path / "old.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in (
        {"chrom": "c1", "start": 50, "end": 20, "type": "UNCOVERED", "read_name": "a"},
        {"contig": "c2", "pos": 7, "svtype": "INS", "SVLEN": 90, "SUPPORT": 0, "prob": 0.25})))
    rows = {r.contig: r for r in tables.read_signatures(spark, str(path)).collect()}
    assert (rows["c1"].tstart, rows["c1"].tend, rows["c1"].svtype, rows["c1"].qname) == (20, 50, "DEL", "a")
    assert (rows["c2"].tstart, rows["c2"].tend, rows["c2"].svlen, rows["c2"].support, rows["c2"].confidence) == (7, 8, 90, 1, 0.25)


def test_records_without_ids_stay_apart(spark, tmp_path):
    """Three loci on two contigs: three calls, though no record has an id and one has no contig."""
    records = [{"contig": contig, "tstart": at + k, "tend": at + 200 + k, "svlen": 200, "svtype": "DEL", "qname": f"{contig}{at}{k}", "mapq": 60}
               for contig, at in (("chr1", 10_000), ("chr1", 90_000), ("chr2", 10_000)) for k in range(5)]
    path = tmp_path / "plain.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [*records, {"tstart": 1, "tend": 2, "svtype": "DEL"}]))
    found = tables.read_signatures(spark, str(path))
    assert found.count() == found.select("sid").distinct().count() == 16
    assert found.where("contig = 'NA'").count() == 1
    parts = cl.partition_by_position(cl.with_bucket(found), GraphParams(10, 0.5, 900))
    clustered = cl.clusters(embed(node_features(parts)), GraphParams(10, 0.5, 900))
    rows = clustered.groupBy("cluster_id", "contig").count().collect()
    assert sorted((r.contig, r["count"]) for r in rows) == [("chr1", 5), ("chr1", 5), ("chr2", 5)]


def test_bed_and_vcf_ids(spark, tmp_path):
    text = "# c\ntrack x\nchr1\t5\t9\textra\nchr1 a b\nchr2\t7\nchr3\t9\t9\n\nchr4  1  2\n"
    (tmp_path / "a.bed").write_text(text)
    with gzip.open(tmp_path / "a.bed.gz", "wt") as handle:
        handle.write(text)
    for name in ("a.bed", "a.bed.gz"):
        assert {tuple(r) for r in tables.read_bed(spark, str(tmp_path / name)).collect()} == {("chr1", 5, 9), ("chr4", 1, 2)}
    (tmp_path / "tp-call.vcf").write_text("##x\n#CHROM\nc\t1\tid1\tN\nc\t2\t.\tN\nc\t3\tid1\tN\nc\t4\n")
    tp, fp = tables.read_truth_labels(spark, str(tmp_path))
    assert [r.id for r in tp.collect()] == ["id1"] and fp.count() == 0
    with pytest.raises(ValueError):
        tables.read_truth_labels(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("name, text, n", [
    ("m.json", '{"sources": [{"data_path": "~/x"}, {"bam_path": "b"}]}', 2), ("m.json", '{"data_path": "x"}', 1),
    ("m.jsonl", '# note\n{"data_path": "x"}\n\n{"data_path": "y"}\n', 2), ("m.csv", "split,data_path\ntrain,x\n", 1),
    ("m.tsv", "split\tdata_path\nTest \tx\n", 1), ("m.json", '[{"bam_path": "b"}]', 1)])
def test_manifests(spark, tmp_path, name, text, n):
    path = tmp_path / name
    path.write_text(text)
    rows = tables.read_source_manifest(spark, str(path))
    assert len(rows) == n and not any(str(r.get("data_path")).startswith("~") for r in rows)


def test_bad_manifests(spark, tmp_path):
    for text, error in (("", ValueError), ('[{"name": "x"}]', ValueError), ("[1]", TypeError)):
        path = tmp_path / "bad.json"
        path.write_text(text)
        with pytest.raises(error):
            tables.read_source_manifest(spark, str(path))
    assert tables.split_name({}) == "train" and tables.split_name({"split": " Test "}) == "test"
    assert tables.number({"a": ""}, "a", int, 4) == 4 and tables.number({"a": "7"}, "a", int) == 7
    assert tables.first_path({"a": "", "b": "/x"}, "a", "b") == "/x"


def test_manifest_features_and_depth_cache(spark, bam_path, tmp_path):
    sigs = str(tmp_path / "s.parquet")
    load_signatures(spark, bam_path=bam_path, save_path=sigs).count()
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps([{"data_path": sigs, "platform": "hifi", "min_mapq": 20, "feature_bam_path": bam_path},
                                    {"bam_path": bam_path, "platform": "ONT", "chrom": "chr1", "extract_kwargs": {"min_sv_size": 60}}]))
    out = manifest_features(spark, str(manifest))
    by_source = {(r.source_id, r.platform): r.n for r in out.groupBy("source_id", "platform").agg(F.count("*").alias("n")).collect()}
    assert set(by_source) == {(0, "ccs"), (1, "ont")} and by_source[0, "ccs"] > by_source[1, "ont"] > 0
    assert out.where("feat[22] > 0").count() > 0
    first, _ = depth_track(spark, tables.read_signatures(spark, sigs), bam_path, 1000, str(tmp_path / "cache"))
    again, _ = depth_track(spark, tables.read_signatures(spark, sigs), bam_path, 1000, str(tmp_path / "cache"))
    plain, _ = depth_track(spark, tables.read_signatures(spark, sigs), bam_path, 1000)
    assert first.exceptAll(again).isEmpty() and plain.exceptAll(again).isEmpty() and again.count() > 0


def test_vcf_and_feature_files(spark, tmp_path):
    rows = [(i, f"c{i % 3}", i * 10, i * 10 + 5, "DEL", -30, 2, 0.5, "PASS", None, {"log_span": 1.5, "alpha": 2.0}) for i in range(50)]
    calls = spark.createDataFrame(rows, "k bigint, contig string, start bigint, end bigint, svtype string, svlen bigint, support bigint, "
                                  "prob double, filter_status string, partner_contig string, score_features map<string,double>")
    calls = assign_call_ids(calls, ["k"])
    write_vcf(calls, str(tmp_path / "out.vcf"))
    parts = sorted(p for p in (tmp_path / "out.vcf").iterdir() if p.name.startswith("part-"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert tuple(lines[:len(HEADER)]) == HEADER and len(lines) == len(HEADER) + 50
    assert [x.split("\t")[2] for x in lines[len(HEADER):]] == [f"call_{i}" for i in range(1, 51)]
    write_call_features(calls, str(tmp_path / "f.jsonl"), "ont", None, "sim")
    raw = json.loads(spark.read.text(str(tmp_path / "f.jsonl")).first()[0])
    assert list(raw) == sorted(raw) and raw["global_coverage"] is None and list(raw["score_features"]) == ["alpha", "log_span"]
    assert tables.read_call_features(spark, str(tmp_path / "f.jsonl")).count() == 50


def test_reference_span_of_bam_matches_cigar(spark, bam_path):
    df = bam.read_bam(spark, bam_path).where("contig is not null")
    items = cg.cigar_items(F.col("cigar"))
    assert df.where((F.col("pos0") + cg.reference_span(items)) != F.col("ref_end")).count() == 0
    assert df.where(cg.query_span(items) != F.col("query_length")).count() == 0


def long_reads(seed, n=400, length=1_000_000_000):
    """Sorted reads of very different lengths on two long contigs, some far behind 512 Mb."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pos = rng.choice((rng.randrange(60_000), 700_000_000 + rng.randrange(200_000), rng.randrange(length)))
        span = rng.choice((50, 3_000, 90_000, 900_000))
        cigar = rng.choice((f"{span}M", f"5S{span - 20}M20D3I", f"{span // 2}M{span // 2}N"))
        bases = sum(int(k) for k, op in cg_ops(cigar) if op in "MIS")
        rows.append({"qname": f"r{i}", "flag": rng.choice((0, 16, 256, 4)), "contig": rng.choice(("big", "other")), "pos0": pos,
                     "ref_end": pos + sum(int(k) for k, op in cg_ops(cigar) if op in "MDN"), "mapq": rng.randrange(61), "cigar": cigar,
                     "seq": "".join(rng.choice("ACGTN") for _ in range(bases)) if bases < 5_000 else "ACGT" * (bases // 4) + "A" * (bases % 4),
                     "query_length": bases, "sa": rng.choice((None, "other,5,+,9M,60,0;", "é"))})
        if rows[-1]["flag"] & 4:
            rows[-1]["ref_end"] = None
    return sorted(rows, key=lambda r: (r["contig"], r["pos0"], r["qname"]))


def cg_ops(cigar):
    return re.findall(r"(\d+)([A-Z=])", cigar)


def test_written_folder_and_long_contigs(spark, tmp_path):
    """A folder written by several tasks, with .csi indexes beyond 512 Mb, against the rows; regions against all rows."""
    rows = long_reads(1)
    lost = {**rows[0], "qname": "lost", "contig": None, "pos0": -1, "flag": 4, "ref_end": None, "cigar": None, "seq": None, "query_length": 0, "sa": None}
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in [*rows, lost]], bam.ALIGNMENTS)
    path = str(tmp_path / "folder")
    bam.write_bam(df.repartition(5), path, [("big", 1_000_000_000), ("other", 1_000_000_000), ("none", 5)], files=4)
    assert len(bam.files_of(path)) > 1 and bam.read_header(path)[0][0] == ("big", 1_000_000_000)
    whole = bam.read_bam(spark, path, splitBytes=1)
    assert as_tuples(whole.where("contig is not null")) == wanted(rows) and whole.where("contig is null").count() == 1
    assert bam.bam_mapped_reads(spark, path).first().n == sum(not r["flag"] & 4 for r in rows)
    some = bam.read_bam(spark, path, columns=["contig", "pos0", "ref_end"])
    assert some.columns == ["contig", "pos0", "ref_end"] and some.count() == len(rows) + 1
    rng = random.Random(2)
    for _ in range(8):
        r = rng.choice(rows)
        start = max(0, r["pos0"] + rng.choice((-200_000, -10, 0, 10, 2_000)))
        stop = start + rng.choice((1, 5_000, 1_000_000))
        got = as_tuples(bam.read_bam(spark, path, r["contig"], start, stop, splitBytes=1))
        assert got == wanted(rows, lambda x: x["contig"] == r["contig"] and x["pos0"] < stop and x["ref_end"] is not None and x["ref_end"] > start)
    empty = str(tmp_path / "empty")
    bam.write_bam(df.limit(0), empty, [("big", 10)], files=1)
    assert bam.read_bam(spark, empty).count() == 0


def test_region_behind_a_long_read(spark, tmp_path):
    """Reads that begin behind a long read which reaches out of the region, with a linear index."""
    spans = [(50, 100), (100, 60_000), (200, 300), (16_000, 500), (17_000, 40_000), (39_000, 10)]
    rows = [{"qname": f"r{i}", "flag": 0, "contig": "c", "pos0": p, "ref_end": p + n, "mapq": 9, "cigar": f"{n}M", "seq": "A" * n, "query_length": n, "sa": None}
            for i, (p, n) in enumerate(spans)]
    path = str(tmp_path / "long.bam")
    write_bam(path, [("c", 200_000)], rows)
    for start, stop in ((0, 1_000), (16_100, 16_200), (30_000, 39_001), (5_000, 100_000)):
        got = {r.qname for r in bam.read_bam(spark, path, "c", start, stop, splitBytes=1).collect()}
        assert got == {r["qname"] for r in rows if r["pos0"] < stop and r["ref_end"] > start}
