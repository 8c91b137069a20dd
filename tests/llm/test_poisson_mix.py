"""Poisson replication: the distribution, the targets, unusual rows."""

import math

import pytest
from pyspark.sql import functions as F

from riftscan.llm import poisson_mix as pm


def test_steps_are_the_distribution(spark):
    for mean in (0.01, 1.0, 16.0):
        steps = spark.range(1).select(pm.poisson_steps(F.lit(mean)).alias("s")).first().s
        total, p = 0.0, math.exp(-mean)
        for k, value in enumerate(steps):
            total += p
            assert math.isclose(value, total)
            p *= mean / (k + 1)
        assert 1 - steps[-1] < 1e-13


def test_targets(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 == 8, "mid").alias("source"))
    got = {r.source: (r.n, r.top) for r in pm.mix(docs, {"big": 1, "mid": 2, None: 1}, total=200_000).groupBy("source").agg(F.count("*").alias("n"), F.max("replica").alias("top")).collect()}
    assert set(got) == {"big", "mid", None}
    for source, share in (("big", 0.25), ("mid", 0.5), (None, 0.25)):
        assert got[source][0] == pytest.approx(200_000 * share, abs=5 * math.sqrt(200_000 * share))
    assert got["mid"][1] > 30
    same = pm.mix(docs, {"big": 1}, total=1000)
    assert [tuple(r) for r in same.orderBy("order_key").collect()] == [tuple(r) for r in pm.mix(docs.repartition(7), {"big": 1}, total=1000).orderBy("order_key").collect()]


def test_unusual_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (2, "a", ""), (None, "b", "x" * 100_000), (3, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = pm.mix(docs, total=400).collect()
    assert {r.source for r in got} == {"a", "b", None} and all(0 <= r.order_key < 1 for r in got)
    twice = [r.replica for r in got if r.doc_id == 2]
    assert sorted(twice) == sorted([k for k in range(max(twice) + 1)] * 2)
    assert pm.mix(docs.limit(0)).count() == 0 and pm.mix(docs, {"c": 1.0}).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a", 5, 7, "x") for i in range(30)], "doc_id long, source string, rate int, replica int, parts string")
    assert pm.replicate(docs, total=300).columns == docs.columns and {r.replica for r in pm.replicate(docs, total=300).collect()} == {7}
    assert {r.rate for r in pm.mix(docs, total=300).collect()} == {5} and pm.mix(docs, total=300).columns == ["doc_id", "source", "rate", "parts", "replica", "order_key"]
