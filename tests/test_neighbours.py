"""Exact neighbours in blocks against all pairs, and the most common element of an array."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riftscan.operators import cluster
from riftscan.operators.calls import most_common
from riftscan.operators.cluster import _nearest_in_blocks, knn_within, nearest_neighbours


def nearest(rows, k):
    out = set()
    for i, g, v in rows:
        if g is None or v is None:
            continue
        found = []
        for j, h, u in rows:
            if h == g and j != i and u is not None:
                cosine = round(float(np.dot(v, u) / np.linalg.norm(v) / np.linalg.norm(u)), 9)
                if cosine > 0:
                    found.append((-cosine, j))
        out |= {(i, j, round(-c, 6)) for c, j in sorted(found)[:k]}
    return out


@pytest.mark.parametrize("block_rows", [7, 40, 16384])
def test_blocks_meet_once_for_both_directions(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(i * 3, "hot" if i % 3 else f"g{i % 5}", [float(x) for x in rng.integers(-3, 4, 6) + 0.5]) for i in range(150)]
    rows += [(1000, None, [1.0] * 6), (1001, "hot", None), (1002, "alone", [1.0] * 6)]
    df = spark.createDataFrame(rows, "ident long, grp_of string, vec array<double>")
    got = knn_within(df, "grp_of", "ident", "vec", 4, block_rows=block_rows).collect()
    assert {(r.src, r.dst, round(r.cosine, 6)) for r in got} == nearest(rows, 4) and len(got) == len({(r.src, r.dst) for r in got})
    assert knn_within(df.limit(0), "grp_of", "ident", "vec", 4).count() == 0


def test_most_common(spark):
    rng = np.random.default_rng(5)
    lists = [[str(x) for x in rng.integers(0, 5, n)] for n in range(12)] + [["b", "a", None, None, None], [None], ["z"] * 3 + ["y"] * 3, None]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, v array<string>").select("i", most_common(F.col("v")).alias("m"))
    for i, m in df.collect():
        counts = Counter(x for x in lists[i] or [] if x is not None)
        assert m == (min(counts, key=lambda x: (-counts[x], x)) if counts else None)


def straight(v, k):
    """The k best others of every row by sorting whole rows of rounded cosines."""
    scores = np.round(v @ v.T, 9)
    out = []
    for i, row in enumerate(scores):
        best = sorted((-s, j) for j, s in enumerate(row.tolist()) if j != i and s > 0)[:k]
        out += [(i, j, -s) for s, j in best]
    return out


@pytest.mark.parametrize("kind", ["apart", "copies", "few values", "one vector", "zeros"])
def test_chunk_neighbours_with_copies(kind):
    rng = np.random.default_rng(6)
    v = {"apart": rng.normal(size=(700, 5)), "copies": rng.normal(size=(40, 5))[rng.integers(0, 40, 700)],
         "few values": rng.integers(-1, 2, (700, 4)) * 1.0, "one vector": np.ones((700, 5)), "zeros": np.eye(5)[rng.integers(0, 5, 700)] * (rng.integers(0, 2, 700)[:, None])}[kind]
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    got = nearest_neighbours(v, 7)
    assert list(zip(*(x.tolist() for x in got))) == straight(v, 7)


def test_equal_vectors_of_a_chunk_meet_once(monkeypatch):
    looked, largest = [], cluster._largest
    monkeypatch.setattr(cluster, "_largest", lambda scores, k: looked.append(scores.size) or largest(scores, k))
    rows, cols, values = nearest_neighbours(np.eye(50)[np.arange(3000) % 50], 10)
    assert len(rows) == 30000 and (rows % 50 == cols % 50).all() and (values == 1).all() and sum(looked) <= 50 * 50


@pytest.mark.parametrize("k", [5, 20])
def test_neighbours_of_copies_stay_small(k):
    """Copies of one vector, and vectors apart, take memory by blocks of scores and not by rows times columns."""
    rng = np.random.default_rng(7)
    for v in (np.ones((6000, 8)), rng.normal(size=(6000, 8))):
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        table = pa.table({"i": np.arange(6000), "v": list(v), "own": np.zeros(6000, int), "lo": np.zeros(6000, int), "hi": np.zeros(6000, int)})
        tracemalloc.start()
        found = _nearest_in_blocks("i", "v", k)(table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.num_rows == 6000 * k and peak < 60e6
