"""Links of embeddings against all pairs, and the lattice decoder against a search."""

import math

import numpy as np
import pyarrow as pa
import pytest

from riftscan.llm import lattice_dedup as ld

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    good = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for n, (i, v, c) in enumerate(good):
        for j, u, d in good[n + 1:]:
            if c == d and len(u) == len(v) and (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= threshold:
                links.append((i, j))
    top = {i: i for i, _, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    count = dict.fromkeys(top, 0)
    for i, j in links:
        count[i] += 1
        count[j] += 1
        i, j = sorted((find(i), find(j)))
        top[j] = i
    return {(i, count[i], find(i), find(i) == i) for i in top}


def planted(seed, dims=64, groups=12, copies=30):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(copies):
            noise = rng.normal(size=dims)
            noise /= np.linalg.norm(noise)
            rows.append(((len(rows) * 7) % 997, [float(x) for x in np.float32(centre + noise * rng.uniform(0.05, 0.5))], int(g % 3)))
    return rows


def test_decoder():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 3, (200, 8))
    point = ld.nearest_point(x)
    own = ((x - point) ** 2).sum(axis=1)
    for v in ld.minimal_vectors():
        assert (own <= ((x - point - v) ** 2).sum(axis=1) + 1e-9).all()
    doubled = np.rint(point * 2)
    assert np.allclose(doubled, point * 2) and np.allclose(point.sum(axis=1) % 2, 0) and (own <= 1 + 1e-9).all()
    assert len(np.unique(ld.minimal_vectors(), axis=0)) == 240


@pytest.mark.parametrize("seed", [3, 4])
def test_planted_groups(spark, seed):
    rows = planted(seed)
    got = ld.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 16)
    rows = planted(9, groups=2, copies=150)
    assert {tuple(r) for r in ld.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_unusual_rows(spark):
    one = [1.0] + [0.5] * 9
    rows = [(1, one, 1), (2, one, 1), (3, [2 * x for x in one], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0] * 10, 1),
            (9, [math.nan] + one[1:], 1), (10, [None] + one[1:], 1), (11, one[:9], 1), (12, [math.inf] + one[1:], 1), (13, [-x for x in one], 1)]
    df = spark.createDataFrame(rows + [rows[0], (None, one, 1)], SCHEMA)
    got = {r.vec_id: tuple(r)[1:] for r in ld.near_duplicates(df).collect()}
    assert got == {i: (0, i, True) for i in range(1, 14)} | {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False)}
    assert ld.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("codes, scale, tables", [(2, 1.4, 17), (3, 1.4, 46)])
def test_narrower_cells(spark, codes, scale, tables):
    plan = ld.Plan(tables, codes, scale)
    rows = planted(5, groups=6)
    assert {tuple(r) for r in ld.near_duplicates(spark.createDataFrame(rows, SCHEMA), plan=plan).collect()} == brute(rows)


def test_plans_miss_as_few_at_every_size():
    plans = [ld.plan_for(rows, 0.93) for rows in (0, 10**6, 10**7, 10**8, 10**9)]
    assert [p.tables for p in plans] == sorted(p.tables for p in plans) and len(set(plans)) == 5
    for p in plans:
        assert (1 - ld.meeting_probability(p.codes, p.scale, 0.93)) ** p.tables < 2 * ld.MISSED
    # What was simulated holds for real vectors.
    rng = np.random.default_rng(8)
    u, z = rng.normal(size=(2, 4000, 48))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    z -= (z * u).sum(axis=1, keepdims=True) * u
    v = 0.93 * u + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    label = np.zeros(4000, np.int64)
    for p in plans[:2]:
        (own_u, near_u), (own_v, near_v) = ld.cells(u, label, p), ld.cells(v, label, p)
        met = (own_u == own_v) | (near_u == own_v[:, :, None]).any(axis=2) | (near_v == own_u[:, :, None]).any(axis=2)
        assert abs(met.mean() - ld.meeting_probability(p.codes, p.scale, 0.93)) < 0.02


def test_bytes_drop_no_pair_at_the_threshold():
    """Vectors with a dominant component lose most to bytes; the carried bound must cover it."""
    rng = np.random.default_rng(2)
    for dims in (8, 64, 1000):
        x = rng.normal(size=(300, dims)) * np.where(np.arange(dims) == 0, dims**0.5, rng.uniform(0.1, 1))
        x[150:] = x[:150] + rng.normal(size=(150, dims)) * 0.3
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(300)), pa.array([0] * 300), pa.array(unit.tolist())], ["vec_id", "label", "embedding"])
        plan = ld.Plan(2, 1, 2.0)
        data = pa.Table.from_batches(ld._members(plan)(iter([batch]))).column("data").to_pylist()
        blob = np.frombuffer(b"".join(data), np.uint8).reshape(300, -1)
        true = unit @ unit.T
        for threshold in (0.5, 0.93, 0.99):
            assert ld._bytes_near(blob, plan.tables, np.arange(300), threshold)[true >= threshold].all()
        if dims < 1000:
            assert not ld._bytes_near(blob, plan.tables, np.arange(300), 0.93)[true < 0.87].any()


def test_labels_of_any_type(spark):
    rows = planted(6, groups=6)
    named = spark.createDataFrame([(i, v, f"label {c}") for i, v, c in rows], SCHEMA.replace("int", "string"))
    assert {tuple(r) for r in ld.near_duplicates(named).collect()} == brute(rows)
