"""The lattice against all segmentations, counts against plain ones, and held-out gain."""

import math
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa

from riftscan.llm import lattice_lm as lm

PATH = P.path("piece_bpe_32k.model")


def every_path(word, lattice):
    text, weight = b" " + word, dict(zip(lattice.pieces, lattice.log, strict=True))
    sums = [1.0] + [0.0] * len(text)
    for e in range(1, len(text) + 1):
        sums[e] = sum(sums[s] * math.exp(weight[text[s:e]]) for s in range(e) if text[s:e] in weight)
    return math.log(sums[-1]) + lattice.log_stop


def test_lattice_sums_over_all_segmentations():
    lattice = lm.Lattice(PATH)
    words = ["the", "thonwh", "é", "中文字", "a" * 70, "x", "...!!", "internationalisation", "Q\x00"]
    got = lattice.log_probabilities(pa.array(words))
    assert np.allclose(got, [every_path(w.encode(), lattice) for w in words])


def test_expected_counts_add_up():
    lattice = lm.Lattice(PATH)
    uses = lattice.expected(pa.array(["the", "onthe"]), np.array([3.0, 2.0]))
    assert math.isclose(uses[lattice.starts].sum(), 5.0)
    assert math.isclose((uses * [len(p) for p in lattice.pieces]).sum(), 3 * 4 + 2 * 6)


def test_documents(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in lm.score(docs, PATH, "crc32(cast(doc_id as string)) % 5 != 1").collect()}
    tokens = {i: [*bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()).split(), None] for i, t in rows}
    held = {i for i in tokens if crc32(str(i).encode()) % 5 == 1}
    counts = Counter(t for i, ts in tokens.items() if i not in held for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(t in counts for t in ts), n)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
    sums = {c: sum(got[i][c] for i in held) for c in ("score", "mixed_score")}
    untrained = sum(r.score for r in lm.score(docs, PATH, "crc32(cast(doc_id as string)) % 5 != 1", rounds=0).collect() if r.doc_id in held)
    assert untrained < sums["score"] < sums["mixed_score"] < 0


def test_score_is_the_lattice_of_every_word(spark):
    """Whole results: two words of one document, weights as the vocabulary has them."""
    docs = spark.createDataFrame([(1, "onthe The"), (2, "zzz")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, PATH, "doc_id = 2", rounds=0).collect()}
    lattice, end = lm.Lattice(PATH), (1 + 0.5) / (2 + 1)
    words = {1: [b"onthe", b"the"], 2: [b"zzz"]}
    for i, of in words.items():
        want = sum(every_path(w, lattice) for w in of) / math.log(10) + len(of) * math.log10(1 - end) + math.log10(end)
        assert math.isclose(got[i].score, want, rel_tol=1e-9)


def test_probabilities_of_words_add_up_to_at_most_one():
    lattice = lm.Lattice(PATH)
    letters = [bytes([b]) for b in range(256) if b != 32]
    words = letters + [a + b for a in letters for b in letters]
    column = pa.StringArray.from_buffers(len(words), *pa.array(words, pa.binary()).buffers()[1:])  # bytes that are no text count too
    assert 0.001 < np.exp(lattice.log_probabilities(column)).sum() <= 1


def test_long_words_are_walked_in_stretches(monkeypatch):
    words = ["ab" * 2500, "internationalisation" * 40, "x"]
    count = np.array([2.0, 1.0, 3.0])
    whole = lm.Lattice(PATH)
    want, uses = whole.log_probabilities(pa.array(words)), whole.expected(pa.array(words), count)
    assert math.isclose((uses * [len(p) for p in whole.pieces]).sum(), 2 * 5001 + 801 + 3 * 2, rel_tol=1e-9)
    monkeypatch.setattr(lm, "_ARC_CELLS", 7)
    assert np.allclose(whole.log_probabilities(pa.array(words)), want) and np.allclose(whole.expected(pa.array(words), count), uses)


def test_unusual_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b A"), (3, "a b A"), (None, "z"), (4, "y" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, PATH).collect()}
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in got.items()} == {1: (1, 1, 8), 2: (1, 1, 8), 3: (4, 4, 8), 4: (2, 2, 8)}
    assert all(r.score < 0 and math.isfinite(r.score) and math.isfinite(r.mixed_score) for r in got.values())
    assert lm.score(docs.limit(0), PATH).count() == 0
    nothing = lm.score(docs, PATH, "false").collect()
    assert len(nothing) == 4 and all(r.n_known == 0 and math.isfinite(r.score) for r in nothing)
