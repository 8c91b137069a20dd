"""Toxicity: order of held-out documents, isotonic regression against brute force, unusual rows."""

import itertools

import numpy as np
import pyarrow as pa

from riftscan.llm import toxicity as tx

HELD = "crc32(cast(doc_id as string)) % 5 = 0"


def test_isotonic_is_the_nearest_monotone_function():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, y = rng.permutation(7).astype(float), rng.integers(0, 2, 7).astype(float)
        last, value = tx.isotonic(x, y)
        assert (np.diff(value) > -1e-9).all() and last[-1] == x.max()
        order = np.argsort(x)
        cost = min(
            sum(((y[order][a:b] - y[order][a:b].mean()) ** 2).sum() for a, b in itertools.pairwise((0, *cuts, 7)))
            for n in range(7) for cuts in itertools.combinations(range(1, 7), n)
            if all(np.diff([y[order][a:b].mean() for a, b in itertools.pairwise((0, *cuts, 7))]) >= 0))
        ends = np.searchsorted(x[order], last, "right")
        blocks = [y[order][a:b] for a, b in itertools.pairwise((0, *ends))]
        assert np.isclose(sum(((b - b.mean()) ** 2).sum() for b in blocks), cost)


def test_features_of_a_text():
    names = tx._names(["idiot"])
    x = dict(zip(tx.FEATURES, tx.features(pa.array(["You IDIOT!! 1d1ot"]), names, np.array([2.0]))[0], strict=True))
    assert np.isclose(x["hits"], 1 / 3) and x["near_share"] == 1 and np.isclose(x["capital_words"], 1 / 3)
    assert np.isclose(x["obfuscated"], 1 / 3) and np.isclose(x["exclamations"], 2 / 17)
    assert (tx.features(pa.array([None, ""]), names, np.array([2.0]))[:, :15] >= 0).all()


def test_held_out_order(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = tx.train(docs, labels.where(f"not ({HELD})"))
    got = tx.score(docs, model).join(labels, "doc_id").where(HELD).select("score", "predicted", "toxic").toPandas()
    rank = got.score.rank()
    one = got.toxic == 1
    auc = (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    print("AUC", auc, "accuracy", (got.predicted == got.toxic).mean(), "clean kept", (got.predicted[~one] == 0).mean(), "toxic found", (got.predicted[one] == 1).mean(), len(model.names))
    assert auc > 0.9


def test_unusual_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "you idiot", 1), (3, "you idiot", 1), (None, "fine day", 1), (4, "w " * 90_000, 1)], "doc_id long, text string, doc int")
    labels = spark.createDataFrame([(3, 1), (2, 0), (1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert tx.score(docs.limit(0), model).count() == 0
    assert {r.score for r in tx.score(docs, tx.train(docs, labels.limit(0))).collect()} == {0.0}
    kept = tx.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 6


def brute_tree(binned, g, h):
    """Best splits by trying every feature and bin, node by node; the value of each row."""
    out = np.zeros(len(g))

    def part(rows, depth):
        if depth == tx.DEPTH:
            out[rows] = g[rows].sum() / (h[rows].sum() + 1) * tx.RATE
            return
        best, left = 1e-6, None
        for f in range(binned.shape[1]):
            for b in range(tx.BINS):
                goes = binned[rows, f] <= b
                x, y = rows[goes], rows[~goes]
                if len(x) >= 8 and len(y) >= 8:
                    gain = g[x].sum() ** 2 / (h[x].sum() + 1) + g[y].sum() ** 2 / (h[y].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > best + 1e-12:
                        best, left = gain, goes
        if left is None:
            left = np.ones(len(rows), bool)
        part(rows[left], depth + 1)
        part(rows[~left], depth + 1)

    part(np.arange(len(g)), 0)
    return out


def test_tree_against_all_splits():
    rng = np.random.default_rng(8)
    for n in (20, 60, 200):
        binned = rng.integers(0, tx.BINS, (n, 3))
        g, h = rng.normal(size=n), rng.uniform(0.05, 0.25, n)
        split, cut, value = tx._grow(binned, g, h)
        node = np.zeros(n, int)
        for _ in range(tx.DEPTH):
            node = 2 * node + 1 + (binned[np.arange(n), split[node]] > cut[node])
        assert np.allclose(value[node - (2 ** tx.DEPTH - 1)], brute_tree(binned, g, h))


def test_scores_of_a_model_by_hand(spark):
    """A whole score step by step: features, bins, trees, calibration."""
    rows = [(i, ("you stupid fool " if i % 3 == 0 else "a kind word ") * (1 + i % 4) + f"n{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic long")
    m = tx.train(docs, labels)
    got = {r.doc_id: r.score for r in tx.score(docs, m).collect()}
    for i, text in rows[:40]:
        x = tx.features(pa.array([text]), m.names, m.weights)[0]
        raw = m.base
        for split, cut, value in m.trees:
            node = 0
            for _ in range(tx.DEPTH):
                f = split[node]
                node = 2 * node + 1 + int(sum(e < x[f] for e in m.edges[f]) > cut[node])
            raw += value[node - (2 ** tx.DEPTH - 1)]
        last, value = m.steps
        step = next((v for e, v in zip(last, value, strict=True) if raw <= e), value[-1])
        assert abs(got[i] - min(max(step, 0), 1)) < 0.05, (i, got[i], step)
        assert (got[i] >= 0.5) == (i % 3 == 0)
