"""Views and loss terms against numpy; band pairs against all pairs."""

import math
import os
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from riftscan.models import objectives as ob
from riftscan.operators import call_pairs as cp
from riftscan.operators.dedup import calls_should_merge


def test_terms(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(3, 0.4, (300, 6)), rng.normal(-2, 1.5, (300, 6))
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(900, None, [1.0] * 6), (901, [1.0], [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>").repartition(7)
    got = ob.vicreg_terms(df, "a", "b", 6, 1.0, 25.0, 2.0).first()
    off = ~np.eye(6, dtype=bool)
    variance = sum(np.maximum(0, 1 - np.sqrt(x.var(0) + 1e-4)).mean() for x in (a, b))
    covariance = sum((np.cov(x.T)[off] ** 2).sum() / 6 for x in (a, b))
    invariance = ((a - b) ** 2).mean()
    assert got.rows == 300
    assert np.allclose([got.invariance, got.variance, got.covariance, got.loss], [invariance, variance, covariance, invariance + 25 * variance + 2 * covariance])
    one = ob.vicreg_terms(df.where("id = 0"), "a", "b", 6).first()
    assert one.rows == 1 and one.covariance == 0
    assert ob.vicreg_terms(df.where("id < 0"), "a", "b", 6).first().rows == 0


def test_views(spark):
    df = spark.range(4000).select("id", F.array_repeat(F.lit(2.0), 8).alias("x")).unionByName(
        spark.createDataFrame([(9999, None)], "id long, x array<double>"))
    rows = ob.with_views(df.repartition(5), "id", "x", 0.5, 0.25, 3).orderBy("id").collect()
    again = ob.with_views(df.coalesce(1), "id", "x", 0.5, 0.25, 3).orderBy("id").collect()
    assert rows == again and rows[-1].view_1 is None
    for view in ("view_1", "view_2"):
        x = np.array([r[view] for r in rows[:-1]])
        assert abs((x == 0).mean() - 0.25) < 0.01
        assert abs(x[x != 0].mean() - 2) < 0.01 and abs(x[x != 0].std() - 0.5) < 0.01
    same = ob.with_views(df, "id", "x", 0.0, 0.0).where("id = 1").first()
    assert list(same.view_1) == list(same.view_2) == [2.0] * 8


def test_type_loss(spark):
    rows = [([1.0, 2.0, 0.5], 1), ([1.0, 2.0, 0.5], 0), ([900.0, 1.0, 2.0], 2), ([3.0, 3.0, 1.0], 0), ([1.0, 1.0, 1.0], -100), ([1.0], None), (None, 0), ([1.0, 2.0], 7)]
    got = {r.label: r for r in ob.type_cross_entropy(spark.createDataFrame(rows, "x array<double>, y int"), "x", "y").collect()}

    def loss(x, y):
        return max(x) + math.log(sum(math.exp(v - max(x)) for v in x)) - x[y]

    assert (got[None].n, got[0].n, got[1].n, got[2].n) == (4, 2, 1, 1)
    assert math.isclose(got[None].loss, sum(loss(x, y) for x, y in rows[:4]) / 4) and got[None].accuracy == 0.5
    assert math.isclose(got[0].loss, (loss(*rows[1]) + loss(*rows[3])) / 2) and got[0].accuracy == 0.5


def test_band_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(("c1", "c2")), rng.choice((0, 10, 1499, 1500, 1501, 2999, 3000, rng.randrange(9000))), rng.choice((100, 130, 400)),
             rng.choice(("DEL", "TRA")), rng.choice((None, "c9"))) for i in range(400)]
    rows = [(i, c, s, s + n, t, n, p) for i, c, s, n, t, p in rows]
    df = spark.createDataFrame(rows, "cluster_id long, contig string, start long, end long, svtype string, svlen long, partner_contig string")
    first, copies = {}, {}
    for i, c, s, e, t, n, p in rows:
        g = (c, t, p or "", s, e, 0 if t == "TRA" else n)
        first.setdefault(g, i)
        copies[g] = copies.get(g, 0) + 1
    want = sorted((first[g], first[h], h[3] - g[3], copies[g], copies[h]) for g in first for h in first
                  if g[:3] == h[:3] and 0 <= h[3] - g[3] <= 1500 and (h[3], first[h]) > (g[3], first[g]))
    for bin_rows in (4096, 3):  # crowded bins are dealt over parts
        got = cp.band_pairs(df, "cluster_id", bin_rows=bin_rows).collect()
        assert sorted((r.id_a, r.id_b, r.gap, r.copies_a, r.copies_b) for r in got) == want
    assert all(r.merge == (r.gap <= 1000) for r in got if r.svtype == "TRA")
    assert cp.band_pairs(df.limit(0), "cluster_id").count() == 0


def test_bins_of_calls_go_to_all_tasks(spark):
    rows = [(i, "c1", 1600 * (i // 40) + i % 40, 1600 * (i // 40) + 100, "DEL", 100, None) for i in range(4000)]
    df = spark.createDataFrame(rows, "cluster_id long, contig string, start long, end long, svtype string, svlen long, partner_contig string")
    # Few bytes make many pairs, so bytes must not decide how many tasks make them.
    per_task = cp.band_pairs(df, "cluster_id").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    want = sum(1 for i in range(4000) for j in range(i + 1, min(4000, i + 81)) if 0 <= rows[j][2] - rows[i][2] <= 1500)
    assert sum(per_task) == want
    assert len(per_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(per_task) < 0.6 * want


def test_band_pairs_of_odd_rows(spark):
    rng = random.Random(5)
    some = lambda value: None if rng.random() < 0.05 else value
    rows = [(some(i % 290), some(rng.choice(("c1", "c2"))), some(s := rng.choice((-1, 0, 5999, 6000, 7000, rng.randrange(-9000, 9000)))),
             some(s + rng.choice((1, 100, 300))), some(rng.choice(("DEL", "INS", "TRA"))), some(rng.randrange(-400, 400)), some("c9")) for i in range(600)]
    df = spark.createDataFrame(rows, "cluster_id long, contig string, start long, end long, svtype string, svlen long, partner_contig string")
    g = cp.geometries(df, "cluster_id").localCheckpoint()
    gap = F.col("b.start") - F.col("a.start")
    follows = (gap > 0) | (gap == 0) & (F.col("b.id") > F.col("a.id"))
    alike = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("contig", "svtype", "partner_key")]
    both = g.select(F.struct("*").alias("a")).crossJoin(g.select(F.struct("*").alias("b"))).where(follows & (gap <= 1500) & alike[0] & alike[1] & alike[2])
    want = both.select("a.contig", "a.svtype", "a.partner_key", F.col("a.id"), F.col("b.id"), gap, calls_should_merge("a", "b"), "a.copies", "b.copies").collect()
    order = lambda found: sorted(map(repr, map(tuple, found)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # calls meet across batches
    try:
        for bin_rows in (4096, 8, 1):
            assert order(cp.band_pairs(df, "cluster_id", bin_rows=bin_rows).collect()) == order(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 1000 and any(r[6] is None for r in want)


def test_band_pairs_write_little(spark):
    def written():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        kept = spark.sparkContext.getCheckpointDir()
        kept = Path(kept.removeprefix("file:")).rglob("part-*") if kept else ()
        return {p: os.path.getsize(p) for p in (*disk.split("\n"), *map(str, kept)) if os.path.isfile(p)}

    # A bin with more calls than one part, and bins with few.
    n = 40_000
    df = spark.range(n).select(
        F.col("id").alias("cluster_id"), F.lit("c1").alias("contig"), F.when(F.col("id") % 50 == 0, 700_000).otherwise(F.col("id") * 40).alias("start"),
        (F.col("id") * 40 + 900).alias("end"), F.lit("DEL").alias("svtype"), F.lit(900).alias("svlen"), F.lit(None).cast("string").alias("partner_contig"))
    before = written()
    cp.band_pairs(df, "cluster_id", bin_rows=200).write.format("noop").mode("overwrite").save()
    # Once to make the geometries and once, a little over, to their units.
    assert 0 < sum(size for p, size in written().items() if p not in before) < 50 * n
