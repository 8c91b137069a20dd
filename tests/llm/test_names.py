"""Every function that carries columns along does so whatever their names, and with one name twice."""

import pytest

from riftscan.llm import poisson_mix, recompression, sharding, tensored_minhash, toxicity

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "text", "__slot", "__mix_copies", "_c0", "Doc_ID", "__kept_text", "bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[i % 5:]) + f" end{i}", "en", "s", 100 + i, i * 10, f"other {i}", i + 0.5, "m", i, -i, "k", True) for i in range(12)]
    schema = ["long", "string", "string", "string", "long", "long", "string", "double", "string", "long", "long", "string", "boolean"]
    return spark.createDataFrame(rows, ", ".join(f"c{i} {t}" for i, t in enumerate(schema))).toDF(*NAMES)


def own(row):
    """What belongs to a row beside its text."""
    return row[0], row[5], row[6], row[7], row[8], row[9], row[10], row[11], row[12]


def wanted(i):
    return i, i * 10, f"other {i}", i + 0.5, "m", i, -i, "k", True


@pytest.mark.parametrize("carry", [
    poisson_mix.replicate, poisson_mix.mix, recompression.drop_repeated_passages, tensored_minhash.keep_one_of_each,
    lambda df: sharding.place(df, "doc_id", ["x", "y"], 31),
    lambda df: toxicity.drop_toxic(df, df.sparkSession.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic long"))],
    ids=["replicate", "mix", "drop_repeated_passages", "keep_one_of_each", "place", "drop_toxic"])
def test_names(docs, carry):
    out = carry(docs)
    assert out.columns[:len(NAMES)] == NAMES
    rows = out.collect()
    assert rows and all(own(r) == wanted(r[0]) for r in rows)


def test_key_that_is_replaced(spark):
    df = spark.createDataFrame([(5, "a"), (6, "b")], "slot long, x string")
    got = sharding.place(df, "slot", ["p", "q"], 31)
    same = sharding.place(df.withColumnRenamed("slot", "k"), "k", ["p", "q"], 31)
    assert got.columns == ["x", "slot", "shard", "shard_name"]
    assert {(r.x, r.shard) for r in got.collect()} == {(r.x, r.shard) for r in same.collect()}
