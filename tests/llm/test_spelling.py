"""Near words, forms and roots against plain Python; signatures lose no near pair."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from riftscan.llm import spelling as sp


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    x, y = sorted((a, b), key=len)
    return any((x[:i] + x[i + 1:] if len(x) == len(y) else x) == (y[:i] + y[i + 1:]) and (len(x) < len(y) or x[i] != y[i]) for i in range(len(y)))


def plain_words(rows, one_in=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return counts


def plain(words):
    form, out = {}, {}
    for w, n in words.items():
        close = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form[w] = close[0] if close and words[close[0]] >= 2 * n else None
        out[w] = [n, len(close), form[w], words.get(form[w])]
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w].append(end)
    return {(w, *v) for w, v in out.items()}


def found(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {tuple(r) for r in sp.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()}


def random_words(rng, n, alphabet="abé", longest=9):
    words = {}
    for _ in range(n):
        words["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, longest)))] = rng.choice((3, 5, 6, 12, 24, 100))
    return words


def test_against_plain(spark):
    rng = random.Random(1)
    words = random_words(rng, 300) | {"x" * 70: 3, "x" * 71: 7, "x" * 70 + "y": 7, "x" * 300: 9, "x" * 150 + "z" + "x" * 149: 2}
    words |= {"a" * (5 + k): 3 * 2**k for k in range(12)}  # a chain of forms
    assert found(spark, words) == plain(words)


def test_hot_signature_in_blocks(spark, monkeypatch):
    """One letter in many numbers, and blocks of a few words."""
    rng = random.Random(2)
    monkeypatch.setattr(sp, "BLOCK", 20)
    monkeypatch.setattr(sp, "PAIRS", 50)
    words = random_words(rng, 250, "ab", 8)
    assert found(spark, words) == plain(words)


def test_signatures_are_exact():
    rng = random.Random(3)
    for _ in range(2000):
        a = "".join(rng.choice("abcdeéx") for _ in range(rng.randrange(1, 14)))
        i = rng.randrange(len(a))
        b = rng.choice((a[:i] + a[i + 1:], a[:i] + rng.choice("abz") + a[i:], a[:i] + rng.choice("abz") + a[i + 1:]))
        letters = sp.Letters([a, b])
        signed = sp.signatures(letters.parts())
        one, two = letters.bitmaps()
        assert (signed[0] == signed[1]).any()
        assert np.bitwise_count(one[0] ^ one[1]) <= 2 and np.bitwise_count(two[0] ^ two[1]) <= 4
        if a != b:
            assert sp.one_edit([a, b], letters, np.array([0]), np.array([1]))[0]
    edges = np.array([0, 3, 4, 9])
    got = {(a, b) for x, y in sp.pairs_within(edges, 2) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for s, e in ((0, 3), (3, 4), (4, 9)) for a in range(s, e) for b in range(a + 1, e)}


def test_words_of_texts(spark):
    rng = random.Random(4)
    texts = ["", None, "Äbc×÷é ABC1defĀghi", "x" * 200_000, *(" ".join(rng.choice(("Colour", "color", "colors", "ÉTÉ")) for _ in range(300)) for _ in range(30))]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(3, texts[5]), (3, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("text2", F.lit("zzz"))
    docs = docs.toDF("doc_id", "text", "a.b", "text")
    for one_in in (97, 3):
        counted = sp.words_with_slips(docs, one_in).groupBy("word").count().collect()
        assert {r.word: r["count"] for r in counted} == dict(plain_words(rows, one_in))
    kept = {w: n for w, n in plain_words(rows).items() if len(w) >= 5 and n >= 3}
    assert {tuple(r) for r in sp.frequent(sp.words_with_slips(docs)).collect()} == set(kept.items())


def test_empty(spark):
    assert sp.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert sp.variants(sp.frequent(sp.words_with_slips(spark.createDataFrame([(1, None)], "doc_id long, text string")))).count() == 0
