"""Two-level scans and call deduplication against plain sequential loops, with tiny blocks and hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftscan.operators import cluster as cl
from riftscan.operators import dedup as dd
from riftscan.operators.prefix import gap_sessions, merge_touching, ranked


def merges(kind, a, b):
    return bool(dd._mergeable(dd._Numbers, kind == "TRA", kind == "INS", a[0], a[1], max(a[2], 1), b[0], b[1], max(b[2], 1)))


def positions(seed, n=400):
    rng = random.Random(seed)
    # A third of all rows sit on one position of one key.
    return [(i, "hot", 5_000) if i % 3 == 0 else (i, rng.choice("ab"), rng.randrange(0, 40_000)) for i in range(n)]


def sequential_sessions(rows, max_gap, max_size):
    out = {}
    for key in {r[1] for r in rows}:
        sess, chunk, size, last = 0, 0, 0, None
        for ident, _, pos in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            if last is not None and pos - last > max_gap:
                sess, chunk, size = sess + 1, 0, 0
            elif size >= max_size:
                chunk, size = chunk + 1, 0
            out[ident] = (key, sess, chunk)
            size, last = size + 1, pos
    return out


@pytest.mark.parametrize("seed, gap, size, block, ids", [(1, 300, 5, 1000, 16), (2, 900, 7, 64, 50), (3, 100, 4000, 1 << 16, 1_000_000)])
def test_gap_sessions(spark, seed, gap, size, block, ids):
    rows = positions(seed)
    df = spark.createDataFrame(rows, "sid bigint, k string, pos bigint")
    got = {r.sid: (r.k, r.sess, r.chunk) for r in gap_sessions(df, ["k"], "pos", "sid", gap, size, block, ids).collect()}
    assert got == sequential_sessions(rows, gap, size)


def test_ranked(spark):
    rows = positions(4)
    df = spark.createDataFrame(rows, "sid bigint, k string, pos bigint")
    got = ranked(df, "no", [F.col("k")], [F.floor(F.col("pos") / 512)], [F.col("pos"), F.col("sid")])
    order = [r.sid for r in got.orderBy("no").collect()]
    assert order == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]))]
    assert got.agg(F.max("no")).first()[0] == len(rows)


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_merge_touching(spark, block):
    rng = random.Random(9)
    rows = [("k", s, s + rng.randrange(1, 40)) for s in (rng.randrange(0, 3000) for _ in range(150))]
    merged = []
    for _, s, e in sorted(rows):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    got = merge_touching(spark.createDataFrame(rows, "k string, start bigint, end bigint"), ["k"], block_bp=block)
    assert sorted((r.start, r.end) for r in got.collect()) == [tuple(m) for m in merged]


def sequential_dedup(calls):
    """The greedy walk, one call after the other, over the whole list."""
    kept, active = [], {}
    for call in calls:
        contig, kind, partner, start, end, size, support, prob, ident = call
        slots = active.setdefault((contig, kind, partner), [])
        while slots and start - kept[slots[0]][3] > 1500:
            slots.pop(0)
        for slot in reversed(slots):
            other = kept[slot]
            if merges(kind, (other[3], other[4], other[5]), (start, end, size)):
                if (support, prob) > (other[6], other[7]):
                    kept[slot] = call
                break
        else:
            kept.append(call)
            slots.append(len(kept) - 1)
    return {c[8] for c in kept}


@pytest.mark.parametrize("seed, block", [(1, 700), (2, 2_000), (3, 1 << 17)])
def test_dedup_calls(spark, seed, block):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        kind = rng.choice(["DEL", "INS", "DUP", "TRA"])
        start = 4_000 if i % 3 == 0 else rng.randrange(0, 14_000)
        size = 0 if kind == "TRA" else rng.choice([30, 60, 200, 900, 2500])
        end = start + 1 if kind in ("INS", "TRA") else start + size
        rows.append((i, "c1", kind, "c2" if kind == "TRA" else None, start, end, -size if kind == "DEL" else size, rng.randrange(1, 4), rng.randrange(1, 9) / 10))
    df = spark.createDataFrame(rows, "ident bigint, contig string, svtype string, partner_contig string, start bigint, end bigint, svlen bigint, support bigint, prob double")
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[3] or "", r[4], r[5], abs(r[6]), r[0]))
    wanted = sequential_dedup([(r[1], r[2], r[3] or "", r[4], r[5], abs(r[6]) if r[2] != "TRA" else 0, r[7], r[8], r[0]) for r in ordered])
    got = {r.ident for r in dd.deduplicate_calls(df, ["ident"], block_bp=block).collect()}
    assert got == wanted


def test_neighbours_and_components():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 6))
    v[100:140] = v[100]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows, cols, values = cl.nearest_neighbours(v, 9)
    scores = np.round(v @ v.T, cl.DIGITS)
    for i in (0, 55, 105, 139, 512, 699):
        wanted = sorted((j for j in range(700) if j != i), key=lambda j: (-scores[i, j], j))[:9]
        assert cols[rows == i].tolist() == wanted
    a, b, w = cl.symmetric_edges(rows, cols, values, 700)
    assert (a < b).all() and len(set(zip(a.tolist(), b.tolist()))) == len(a)
    keep = w >= 0.9
    label = cl.component_labels(700, a[keep], b[keep])
    parent = list(range(700))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a[keep].tolist(), b[keep].tolist()):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    assert label.tolist() == [find(i) for i in range(700)]


def test_groups_survive_batch_borders(spark):
    """A group that spans several Arrow batches is still seen as one."""
    import pyarrow as pa
    from pyspark.sql import types as T

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 9).alias("k"), "id")
        schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
        out = cl.chunk_stream(df, ["k"], ["id"], schema, lambda t: pa.table({"k": t.column("k")[:1], "n": pa.array([t.num_rows])}))
        got = {r.k: r.n for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: len(range(k, 200, 9)) for k in range(9)}
