"""Recall and scores against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from riftscan.llm import graph_search as gs

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        score = (x * x[n]).sum(axis=1)
        order = [m for m in np.lexsort((ids, -score)) if m != n][:k]
        out[int(ids[n])] = [(int(ids[m]), float(score[m])) for m in order]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in want[q]} & {r.vec_id for r in got if r.query_id == q}) for q in want)
    return hits / sum(map(len, want.values()))


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, 5, 50)
    got = gs.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 5 * len(want) and recall(got, want) > 0.95
    true = {(q, v): s for q, each in want.items() for v, s in each}
    assert all(math.isclose(r.score, true[r.query_id, r.vec_id], rel_tol=1e-12) for r in got if (r.query_id, r.vec_id) in true)


def test_several_shards_and_copies(spark, monkeypatch):
    monkeypatch.setattr(gs, "SHARD_ROWS", 120)
    monkeypatch.setattr(gs, "QUERY_ROWS", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 16))
    rows = [(i, [float(v) for v in np.float32(centres[i % 9] + rng.normal(size=16) * 0.4)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(90)]
    got = gs.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, 5, 10)
    assert recall(got, want) > 0.97
    copies = sorted((r.rank, r.vec_id) for r in got if r.query_id == 1080)
    assert copies == [(1, 50), (2, 1000), (3, 1001), (4, 1002), (5, 1003)]


def test_unusual_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(0, one), (1, one), (2, None), (50, []), (100, [0.0] * 3), (150, [math.nan, 1.0, 1.0]), (3, [None, 1.0, 1.0]), (4, [3.0, 2.0, 1.0]),
            (5, [1.0, 2.0]), (200, [2.0, 4.0, 6.0]), (None, one), (4, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in gs.nearest(df, F.col("vec_id") % 50 == 0).collect())
    last = round(10 / 14, 9)
    assert [g[:2] for g in got] == [(0, 1), (0, 2), (0, 3), (200, 1), (200, 2), (200, 3)]
    assert got[2] == (0, 3, 4, last) and got[5] == (200, 3, 4, last) and got[3][2] == 0 and got[4][2] == 1
    assert gs.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def scored(got, want):
    """Share of answers whose score is one of the true scores: among many ties any id is as near."""
    true = {q: [s for _, s in each] for q, each in want.items()}
    return sum(any(abs(r.score - s) < 1e-9 for s in true[r.query_id]) for r in got) / sum(map(len, want.values()))


def test_tight_groups_and_multiples(spark, monkeypatch):
    """40 tight groups, and 300 multiples of one vector among 600 others, over at least three shards."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    tight = [(i, [float(v) for v in np.float32(centres[i % 40] + rng.normal(size=32) * 0.02)]) for i in range(2400)]
    monkeypatch.setattr(gs, "SHARD_ROWS", 700)
    index = gs.build_index(spark.createDataFrame(tight, SCHEMA))
    assert index.select("size", "shard").distinct().count() >= 3
    assert recall(gs.nearest(spark.createDataFrame(tight, SCHEMA), F.col("vec_id") % 10 == 0).collect(), brute(tight, 5, 10)) > 0.95

    monkeypatch.setattr(gs, "SHARD_ROWS", 200)
    one = rng.normal(size=16)
    rows = [(i, [float(v) for v in one * (i + 1) * 0.37]) for i in range(300)] + [(1000 + i, [float(v) for v in rng.normal(size=16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = gs.nearest(df, F.col("vec_id") % 10 == 0).collect(), brute(rows, 5, 10)
    assert len(got) == sum(map(len, want.values())) and scored(got, want) > 0.95
    assert recall([r for r in got if r.query_id >= 1000], {q: v for q, v in want.items() if q >= 1000}) > 0.95


def test_ties_beyond_the_beam():
    """More equally near nodes than a beam holds: the answer still has the smallest ids."""
    n = 500
    x = np.zeros((n, n + 1))
    x[:, 0] = 1
    x[np.arange(n), np.arange(n) + 1] = 1  # all at one angle to the first axis
    edges, entries = gs.build_graph((x / math.sqrt(2)).astype(np.float32))
    shard = gs.Shard.__new__(gs.Shard)
    shard.x, shard.edges, shard.entries, shard.first = (x / math.sqrt(2)).astype(np.float32), edges, entries, np.arange(n + 1)
    shard.exact, shard.ids = x / math.sqrt(2), [[i] for i in range(n)]
    q = np.zeros((1, n + 1))
    q[0, 0] = 1
    assert [v for _, v in shard.nearest(np.array([-1]), q, 5)[0]] == [0, 1, 2, 3, 4]


def test_fewer_distances_than_rows():
    """A search computes fewer than a fifth of the rows' distances once a shard has some ten thousand."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, 12_000)] + rng.normal(size=(12_000, 24)) * 0.5).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entries = gs.build_graph(x)
    found = gs.beam_search(x, edges, entries, x[:200], gs.SEARCH_BEAM)
    assert found.computed / 200 < 12_000 / 5
    want = np.argsort(-(x[:200] @ x.T), axis=1, kind="stable")[:, :6]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 6 for a, b in zip(found.ids, want, strict=True)]) > 0.95
