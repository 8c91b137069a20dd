"""Whole runs and the command line."""

import json

import pytest
from bam_fixture import write_bam
from fresh_weights import init_encoder, init_scorer
from pyspark.sql import functions as F

from riftscan import cli
from riftscan.models import encoder as en
from riftscan.models import scorer as sc
from riftscan.operators import cluster as cl
from riftscan.operators import features as ft
from riftscan.plans import fixtures as fx
from riftscan.plans.inference import RunConfig, call_params, input_domain, run_inference
from riftscan.presets import select_preset

FIELDS = ["qname", "flag", "contig", "pos0", "ref_end", "mapq", "cigar", "seq", "query_length", "sa"]


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """A signature table, an indexed BAM file and small checkpoints."""
    root = tmp_path_factory.mktemp("run")
    fx.sig(spark, sf_dir).write.parquet(str(root / "sigs.parquet"))
    rows = [r.asDict() for r in fx.aln(spark, sf_dir).select(*FIELDS).orderBy("contig", "pos0", "qname").collect()]
    # Repeat a read with a clear deletion, so that one event has support.
    base = {"flag": 0, "contig": "chr2", "pos0": 50_000, "ref_end": 50_900, "mapq": 60, "cigar": "400M100D400M",
            "seq": "ACGT" * 200, "query_length": 800, "sa": None}
    rows += [{**base, "qname": f"del{i}", "pos0": 50_000 + i, "ref_end": 50_900 + i} for i in range(6)]
    rows.sort(key=lambda r: (r["contig"], r["pos0"], r["qname"]))
    write_bam(str(root / "sample.bam"), [(f"chr{i}", 140_000) for i in range(1, 6)], rows)
    en.save_weights(init_encoder(27, 8, (16,), 3), str(root / "enc.npz"))
    n = len(sc.SCORER_FEATURES)
    en.save_weights(init_scorer((4, 4, 4), 8), str(root / "scorer.npz"), {
        "model_type": sc.MODEL_TYPE, "feature_names": list(sc.SCORER_FEATURES), "mean": [0.0] * n, "scale": [1.0] * n,
        "threshold": 0.9, "platform_thresholds": {"ont": 0.01}})
    return root


def vcf_records(path):
    lines = []
    for part in sorted(p for p in path.iterdir() if p.name.startswith("part-")):
        lines += part.read_text().splitlines()
    return [line.split("\t") for line in lines if not line.startswith("#")]


def test_run_on_a_table(spark, folder):
    out = folder / "table"
    result = run_inference(spark, RunConfig(platform="ont", output_dir=str(out), data_path=str(folder / "sigs.parquet"), include_tra=True,
                                            global_coverage=5.0, save_call_features_path=str(out / "features.jsonl")))
    meta = json.loads((out / "run_metadata.json").read_text())
    records = vcf_records(out / "calls.vcf")
    assert len(records) == result["n_calls"] == meta["n_calls"]
    assert meta["cluster_scorer_threshold_source"] == "preset" and meta["domain"] == "real"
    assert [(r[0], int(r[1])) for r in records] == sorted((r[0], int(r[1])) for r in records)
    n_features = spark.read.text(str(out / "features.jsonl")).count()
    assert n_features >= result["n_calls"]
    assert n_features - result["n_calls"] == meta["filter_stats"].get("rule_postfilter", 0)


def test_run_on_a_bam_with_models(spark, folder):
    out = folder / "bam_sim"
    stages = []
    result = run_inference(spark, RunConfig(
        platform="ont", output_dir=str(out), bam_path=str(folder / "sample.bam"), model_path=str(folder / "enc.npz"),
        cluster_scorer_path=str(folder / "scorer.npz"), save_embeddings=True, progress_json_path=str(out / "progress.json")),
        lambda stage, payload: stages.append(stage))
    assert result["global_coverage"] > 0 and stages[0] == "start" and stages[-1] == "done"
    assert json.loads((out / "progress.json").read_text())["stage"] == "done"
    meta = json.loads((out / "run_metadata.json").read_text())
    assert meta["domain"] == "sim" and meta["cluster_scorer_threshold_source"] == "platform_threshold:ont"
    assert len(spark.read.parquet(str(out / "embeddings.parquet")).first().emb) == 8
    records = vcf_records(out / "calls.vcf")
    event = [r for r in records if r[0] == "chr2" and r[4] == "<DEL>" and abs(int(r[1]) - 50_402) < 5]
    assert len(event) == 1 and "SUPPORT=6" in event[0][7] and "CSCORE=" in event[0][7] and "SVLEN=-100" in event[0][7]


def test_run_needs_signatures(spark, folder):
    with pytest.raises(ValueError):
        run_inference(spark, RunConfig(platform="ont", output_dir=str(folder / "none"), data_path=str(folder / "sigs.parquet"),
                                       chrom="chr1", start=10**9, end=10**9 + 1))


def test_call_parameters(spark):
    params = call_params(RunConfig("ont", "/tmp/x"), select_preset(spark, "ont", 20.0), 20.0)
    assert params.min_support_by_type == {"DEL": 5, "INS": 4, "DUP": 6, "INV": 6, "TRA": 6}
    assert params.prefilter_mode == "balanced" and params.min_support == 1
    assert input_domain(RunConfig("ont", "/x/Simulated")) == "sim" and input_domain(RunConfig("ont", "/sim", domain="real")) == "real"


def test_clusters_cover_chunks_once(spark, sf_dir):
    """Properties: members are unique, clusters stay inside their chunk, clustering is repeatable."""
    df = ft.node_features(fx.sig(spark, sf_dir)).withColumn("emb", ft.l2_normalise(F.col("feat")))
    params = select_preset(spark, "clr", 5.0).graph
    a, b = (cl.clusters(df, params, True).select("sid", "cluster_id", "contig", "bucket", "sess", "chunk") for _ in range(2))
    assert a.exceptAll(b).isEmpty() and a.count() == a.select("sid").distinct().count()
    spread = a.groupBy("cluster_id").agg(F.count_distinct(F.struct("contig", "bucket", "sess", "chunk")).alias("n"))
    assert spread.where("n > 1").isEmpty()


def test_cli_parses_like_users_expect():
    args = cli.build_arg_parser().parse_args(["infer", "--platform", "ccs", "--bam-path", "sample.bam", "--chrom", "22", "--output_dir", "out"])
    assert (args.command, args.platform, args.bam_path, args.chrom, args.output_dir) == ("infer", "ccs", "sample.bam", "22", "out")


def test_cli_commands(spark, folder, capsys):
    sigs, out = str(folder / "cli_sigs.parquet"), folder / "cli"
    assert cli.main(["extract", "--bam-path", str(folder / "sample.bam"), "--output", sigs, "--chrom", "chr1-3"], spark) == 0
    assert {r.contig for r in spark.read.parquet(sigs).select("contig").distinct().collect()} <= {f"chr{i}" for i in range(1, 6)}
    assert cli.main(["infer", "--platform", "ont", "--signatures", sigs, "--output-dir", str(out), "--include-tra",
                     "--save-call-features-path", str(out / "f.jsonl")], spark) == 0
    assert (out / "run_metadata.json").exists()
    with pytest.raises(SystemExit):
        cli.main(["infer", "--platform", "ont", "--output-dir", str(out)], spark)
    assert cli.main(["encoder-rows", "--signatures", sigs, "--platform", "ont", "--output-path", str(folder / "enc_rows"), "--max-records", "200"], spark) == 0
    assert spark.read.parquet(str(folder / "enc_rows" / "train")).count() == 200
    assert spark.read.parquet(str(folder / "enc_rows" / "statistics")).count() == 27
    truth = folder / "truth"
    truth.mkdir()
    records = [{"call_id": f"call_{i}", "score_features": {"log_span": float(i % 7), "prob_base": i % 2 + 0.0}} for i in range(60)]
    (folder / "calls.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    for name, keep in (("tp-call.vcf", 1), ("fp.vcf", 0)):
        (truth / name).write_text("#h\n" + "".join(f"c\t1\tcall_{i}\tN\n" for i in range(60) if i % 2 == keep))
    assert cli.main(["scorer-rows", "--train-call-features", str(folder / "calls.jsonl"), "--train-truvari-dir", str(truth), "--platform", "ont",
                     "--output-path", str(folder / "sc_rows")], spark) == 0
    rows = spark.read.parquet(str(folder / "sc_rows" / "train")).collect()
    assert len(rows) == 60 and all(len(r.x) == len(sc.SCORER_FEATURES) for r in rows) and sum(r.y for r in rows) == 30
    assert "vcf=" in capsys.readouterr().out


def test_nothing_in_nothing_out(spark, sf_dir):
    from riftscan.operators import bed as bd
    from riftscan.operators import depth as dp
    from riftscan.operators.dedup import deduplicate_calls
    from riftscan.plans import catalog

    none = fx.sig(spark, sf_dir).where("sid < 0")
    parts = cl.partition_by_position(cl.with_bucket(none), catalog.CALL_GRAPH)
    embedded = en.embed(ft.node_features(parts), init_encoder(27, 8, (8,), 1))
    assert cl.clusters(embedded, catalog.CALL_GRAPH).count() == 0
    assert cl.affinity_edges(embedded, catalog.CALL_GRAPH).count() == 0
    assert dp.depth_bins(dp.primary_intervals(fx.aln(spark, sf_dir)), dp.contig_bounds(none)).count() == 0
    assert deduplicate_calls(catalog._sig_calls(spark, sf_dir).where("start < 0"), ["cluster_id"]).count() == 0
    assert bd.overlapping(fx.sig(spark, sf_dir), fx.bed(spark, sf_dir).where("start < 0")).count() == 0
