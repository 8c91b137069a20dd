"""Near duplicates against all pairs of full sets."""

import random

import duckdb
import pytest

from riftscan.llm import tensored_minhash as tm
from riftscan.llm.components import components


def shingles(text, k):
    w = (text or "").encode()
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def closure(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = {}
    for hs in holders.values():
        for n, a in enumerate(hs):
            for b in hs[n + 1:]:
                common[a, b] = common.get((a, b), 0) + 1
    links = [p for p, c in common.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    top = closure(sets, links)
    return {(i, len(s), top[i], top[i] == i) for i, s in sets.items()}


def edited_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    rows, last = [], []
    for i in range(150):
        if last and rng.random() < 0.75:
            w = list(rng.choice(last))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        last.append(w)
        rows.append((1000 - i * 2, rng.choice([" ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 5)])
def test_edited_copies(spark, seed, k):
    rows = edited_rows(seed)
    got = tm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()
    assert {tuple(r) for r in got} == brute(rows, k)


def test_documents(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = tm.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2).collect()
    assert {tuple(r) for r in got} == brute(rows, 2)


def test_unusual_rows(spark):
    rows = [(3, None), (4, ""), (5, "One"), (6, "one "), (7, "é"), (8, "a b c"), (9, "A\tb\nC"), (9, "A\tb\nC"), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in tm.near_duplicates(docs, 2).collect()}
    assert got == {3: (0, 3, True), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False), 7: (1, 7, True), 8: (2, 8, True), 9: (2, 8, False)}
    assert tm.near_duplicates(docs.limit(0)).count() == 0
    kept = tm.keep_one_of_each(docs.withColumn("n_chars", docs.doc_id), 2)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 7, 8]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (50, 40), (40, 60), (7, 7), (None, 5)] + [(i, i + 1) for i in range(100, 140)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(map(tuple, got)) == {1: 1, 2: 1, 3: 1, 9: 1, 50: 40, 40: 40, 60: 40} | {i: 100 for i in range(100, 141)}
