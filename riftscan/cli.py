"""Command line: infer, extract, encoder-rows and scorer-rows. Run it with spark-submit or python -m."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import svtype as sv
from .models.scorer import labelled_vectors
from .operators.evaluate import feature_stats, sample_records
from .operators.extract import ExtractParams, extract_signatures
from .operators.features import FULL_DIM
from .plans.inference import RunConfig, load_alignments, run_inference, source_features
from .session import build_session
from .sources.tables import first_path, number, read_call_features, read_manifest, read_truth_labels, split_name, write_signatures


def _options(parser: argparse.ArgumentParser, names: dict[str, type], **shared: object) -> None:
    """Add ``--some-name`` (also spelled ``--some_name``) for every entry of name -> type."""
    for name, kind in names.items():
        spellings = [f"--{name.replace('_', '-')}"] + ([f"--{name}"] if "_" in name else [])
        if kind is bool:
            parser.add_argument(*spellings, dest=name, action="store_true")
        else:
            parser.add_argument(*spellings, dest=name, type=kind, **{"default": None, **shared})


_EXTRACT = {name: int for name in ExtractParams.__dataclass_fields__}
_PLATFORMS = ("ont", "ccs", "clr")


def build_arg_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="riftscan", description="Structural variants from long reads, on Spark.")
    parser.add_argument("--log-level", dest="log_level", type=str.upper, default="INFO")
    parser.add_argument("--log-file", dest="log_file", default=None)
    commands = parser.add_subparsers(dest="command", required=True)

    infer = commands.add_parser("infer", help="call variants from an indexed BAM file or a signature table")
    infer.add_argument("--platform", required=True, choices=_PLATFORMS)
    infer.add_argument("--output-dir", "--output_dir", dest="output_dir", required=True)
    infer.add_argument("--domain", default="auto", choices=["auto", "real", "sim"])
    _options(infer, {
        "bam_path": str, "signatures": str, "output_vcf": str, "chrom": str, "start": int, "end": int, "model_path": str,
        "cluster_scorer_path": str, "disable_default_scorer": bool, "global_coverage": float, "include_tra": bool,
        "save_signatures_path": str, "save_call_features_path": str, "cluster_scorer_threshold": float,
        "coverage_bin_size": int, "coverage_sample_reads": int, "coverage_cache_path": str, "min_svlen": int, "split_alleles": bool,
        "length_ratio_threshold": float, "save_embeddings": bool, "verbose_progress": bool, "progress_json_path": str, **_EXTRACT})

    extract = commands.add_parser("extract", help="extract signatures from an indexed BAM file")
    extract.add_argument("--bam-path", "--bam_path", dest="bam_path", required=True)
    extract.add_argument("--output", required=True)
    _options(extract, {"chrom": str, "start": int, "end": int, **_EXTRACT})

    encoder = commands.add_parser("encoder-rows", help="write feature rows of signatures, for training an encoder elsewhere")
    encoder.add_argument("--output-path", "--output_path", dest="output_path", required=True)
    _options(encoder, {
        "manifest": str, "signatures": str, "bam_path": str, "feature_bam_path": str, "save_signatures_path": str, "name": str,
        "platform": str, "chrom": str, "start": int, "end": int, "max_records": int, "use_bam_depth_features": bool,
        "coverage_bin_size": int, "input_dim": int, "seed": int})

    scorer = commands.add_parser("scorer-rows", help="write labelled vectors of calls, for training a scorer elsewhere")
    scorer.add_argument("--output-path", "--output_path", dest="output_path", required=True)
    scorer.add_argument("--domain", default="real", choices=["real", "sim", ""])
    _options(scorer, {
        "manifest": str, "train_call_features": str, "train_truvari_dir": str, "validation_call_features": str,
        "validation_truvari_dir": str, "test_call_features": str, "test_truvari_dir": str, "platform": str})
    return parser


def _given(args: argparse.Namespace, renames: dict[str, str]) -> dict:
    """Arguments that were set, under the names a function knows them by."""
    return {new: getattr(args, old) for old, new in renames.items() if getattr(args, old) is not None}


def _extract_params(args: argparse.Namespace) -> ExtractParams:
    return ExtractParams(**_given(args, {n: n for n in _EXTRACT}))


def run_infer(spark: SparkSession, args: argparse.Namespace) -> int:
    if not args.bam_path and not args.signatures:
        raise SystemExit("pass --bam-path or --signatures")
    same = [n for n in RunConfig.__dataclass_fields__ if n not in ("extract", "data_path")]
    cfg = RunConfig(**_given(args, {n: n for n in same}), data_path=args.signatures, extract=_extract_params(args))
    result = run_inference(spark, cfg)
    print(f"vcf={result['output_vcf']}\nmetadata={result['metadata_path']}")
    return 0


def run_extract(spark: SparkSession, args: argparse.Namespace) -> int:
    params = _extract_params(args)
    reads = load_alignments(spark, args.bam_path, args.chrom, args.start, args.end)
    start = args.start if args.chrom and args.end is not None else None
    write_signatures(extract_signatures(reads, params, start), args.output, {"bam_path": args.bam_path, "chrom": args.chrom})
    print(f"signatures={args.output}")
    return 0


def encoder_rows(spark: SparkSession, rows: list[dict], split: str, params: ExtractParams, bin_size: int, feature_dim: int,
                 depth: bool, seed: int) -> DataFrame | None:
    """Rows (id, x, y) of one split of an encoder manifest; None if the split has no source."""
    merged = None
    for index, row in enumerate(r for r in rows if split_name(r) == split):
        source = {**row, "data_path": first_path(row, "data_path", "signatures_path", "signatures_pkl", "signatures"),
                  "bam_path": first_path(row, "bam_path", "bam")}
        depth_bam = first_path(row, "feature_bam_path") or (source["bam_path"] if depth else None)
        if source["data_path"] and not depth_bam:
            source["bam_path"] = None
        source["feature_bam_path"] = depth_bam
        found = source_features(spark, source, index, params, bin_size, feature_dim)
        part = found.select(F.concat_ws(":", "source_id", "sid").alias("id"), F.col("feat").alias("x"),
                            sv.svtype_id(F.col("svtype"), F.col("guess")).alias("y"))
        limit = number(row, "max_records", int)
        if limit and limit > 0:
            part = sample_records(part, limit, "id", seed)
        merged = part if merged is None else merged.unionByName(part)
    return merged


def write_splits(sets: dict[str, DataFrame | None], path: str) -> None:
    """Rows (id, x, y) of every split, and per dimension the mean and scale that standardise the training split."""
    if sets["train"] is None:
        raise SystemExit("no training sources: pass --manifest, or the paths of one source")
    for split, rows in sets.items():
        if rows is not None:
            rows.select("id", "x", "y").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{split}")
    train = sets["train"].sparkSession.read.parquet(f"{path.rstrip('/')}/train")
    size = len((train.select("x").first() or [[]])[0])
    feature_stats(train, "x", size).write.mode("overwrite").parquet(f"{path.rstrip('/')}/statistics")
    print(f"rows={path}")


def run_encoder_rows(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = read_manifest(spark, args.manifest) if args.manifest else []
    if args.signatures or args.bam_path:
        rows.append({"split": "train", "signatures": args.signatures, **{n: getattr(args, n) for n in (
            "name", "bam_path", "feature_bam_path", "save_signatures_path", "platform", "chrom", "start", "end", "max_records")}})
    write_splits({split: encoder_rows(spark, rows, split, ExtractParams(), args.coverage_bin_size or 1000, args.input_dim or FULL_DIM,
                                      args.use_bam_depth_features, args.seed or 42) for split in ("train", "validation")}, args.output_path)
    return 0


def scorer_rows(spark: SparkSession, rows: list[dict], split: str) -> DataFrame | None:
    """Labelled vectors of one split of a scorer manifest."""
    merged = None
    for row in (r for r in rows if split_name(r) == split):
        features, truth = first_path(row, "call_features", "call_features_path"), first_path(row, "truvari_dir", "truvari")
        if not features or not truth:
            raise ValueError(f"manifest row of split {split} needs call_features and truvari_dir: {row}")
        records = annotate_records(read_call_features(spark, features), row)
        part = labelled_vectors(records, *read_truth_labels(spark, truth))
        merged = part if merged is None else merged.unionByName(part)
    return merged


def annotate_records(records: DataFrame, row: dict) -> DataFrame:
    """Domain, platform and dataset name of the manifest row, where it has them, over the records' own."""
    for column, value in (("domain", str(row.get("domain") or "").strip().lower()),
                          ("platform", str(row.get("platform") or "").strip().lower()),
                          ("dataset_name", str(row.get("dataset", row.get("name")) or "").strip())):
        if value:
            records = records.withColumn(column, F.lit(value))
    return records


def run_scorer_rows(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = read_manifest(spark, args.manifest) if args.manifest else []
    for split in ("train", "validation", "test"):
        features, truth = getattr(args, f"{split}_call_features"), getattr(args, f"{split}_truvari_dir")
        if features and truth:
            rows.append({"split": split, "call_features": features, "truvari_dir": truth, "domain": args.domain, "platform": args.platform})
    write_splits({split: scorer_rows(spark, rows, split) for split in ("train", "validation", "test")}, args.output_path)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_arg_parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if args.log_file:
        handlers.append(logging.FileHandler(args.log_file, encoding="utf-8"))
    logging.basicConfig(level=getattr(logging, args.log_level), handlers=handlers, force=True,
                        format="%(asctime)s %(levelname)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    run = {"infer": run_infer, "extract": run_extract, "encoder-rows": run_encoder_rows, "scorer-rows": run_scorer_rows}
    return run[args.command](spark or build_session(), args)


if __name__ == "__main__":
    raise SystemExit(main())
