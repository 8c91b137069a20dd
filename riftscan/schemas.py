"""Declared schemas of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

ALIGNMENTS = T.StructType([
    T.StructField("qname", T.StringType()),
    T.StructField("flag", T.IntegerType()),
    T.StructField("contig", T.StringType()),
    T.StructField("pos0", T.LongType()),
    T.StructField("ref_end", T.LongType()),
    T.StructField("mapq", T.IntegerType()),
    T.StructField("cigar", T.StringType()),
    T.StructField("seq", T.StringType()),
    T.StructField("query_length", T.IntegerType()),
    T.StructField("sa", T.StringType()),
])

SIGNATURES = T.StructType([
    T.StructField("sid", T.LongType()),
    T.StructField("contig", T.StringType()),
    T.StructField("tstart", T.LongType()),
    T.StructField("tend", T.LongType()),
    T.StructField("svtype", T.StringType()),
    T.StructField("svlen", T.LongType()),
    T.StructField("qname", T.StringType()),
    T.StructField("mapq", T.IntegerType()),
    T.StructField("strand", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("insert_seq", T.StringType()),
    T.StructField("num_splits", T.IntegerType()),
    T.StructField("sa_contigs", T.ArrayType(T.StringType())),
    T.StructField("sorted_aligns", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("bkps", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("svm_score", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("support", T.IntegerType()),
    T.StructField("platform", T.StringType()),
])

#: Columns that every signature must carry with a value.
REQUIRED_SIGNATURE_FIELDS = (
    "sid", "contig", "tstart", "tend", "svlen", "source", "strand",
    "mapq", "confidence", "num_splits", "support",
)

CALL_FEATURE_RECORD = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("global_coverage", T.DoubleType()),
    T.StructField("contig", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("svtype", T.StringType()),
    T.StructField("svlen", T.LongType()),
    T.StructField("support", T.LongType()),
    T.StructField("prob", T.DoubleType()),
    T.StructField("score_features", T.MapType(T.StringType(), T.DoubleType())),
])

MANIFEST_RECORD = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("sample_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("data_path", T.StringType()),
    T.StructField("signatures_path", T.StringType()),
    T.StructField("signatures", T.StringType()),
    T.StructField("bam_path", T.StringType()),
    T.StructField("bam", T.StringType()),
    T.StructField("feature_bam_path", T.StringType()),
    T.StructField("save_signatures_path", T.StringType()),
    T.StructField("call_features", T.StringType()),
    T.StructField("call_features_path", T.StringType()),
    T.StructField("truvari_dir", T.StringType()),
    T.StructField("truvari", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("coverage", T.DoubleType()),
    T.StructField("coverage_bin_size", T.IntegerType()),
    T.StructField("max_records", T.LongType()),
    T.StructField("extract_kwargs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("chrom", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("min_sv_size", T.LongType()),
    T.StructField("max_sv_size", T.LongType()),
    T.StructField("min_mapq", T.IntegerType()),
    T.StructField("min_read_len", T.IntegerType()),
    T.StructField("min_siglength", T.IntegerType()),
    T.StructField("merge_del_threshold", T.IntegerType()),
    T.StructField("merge_ins_threshold", T.IntegerType()),
    T.StructField("max_split_parts", T.IntegerType()),
])
