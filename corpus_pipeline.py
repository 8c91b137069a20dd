"""A training corpus in five stages; each works on all that the one before it kept.

Columns of documents: doc_id, text, lang, source, n_chars; others are carried along until the last stage. Rows with a
null doc_id are judged by their text in the first stage, belong to no group of copies, and go through the rest as they
are. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riftscan.llm import byte_bpe, poisson_mix, recompression, tensored_minhash, toxicity
from riftscan.llm.tables import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Words of a passage that is removed where it stands again: passages of over 50 words are found whatever surrounds them.
WINDOW = 13


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of toxicity, learned from the labels, doesn't reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return tensored_minhash.keep_one_of_each(docs, shingle=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has."""
    return recompression.drop_repeated_passages(docs, WINDOW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until all sources weigh the same, shuffled."""
    return poisson_mix.replicate(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to, of every copy."""
    return byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The stages' models and iterations have no SQL; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
