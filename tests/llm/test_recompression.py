"""Repeated windows against a brute-force search."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riftscan.llm import recompression as rc
from riftscan.llm.text import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, window):
    words = {i: (t or "").encode().split() for i, t in rows}
    least = {}
    for i in sorted(words):
        for a in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][a:a + window]), i)
    out = set()
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - window + 1):
            if least[tuple(w[a:a + window])] < i:
                gone |= set(range(a, a + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, window=13):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rc.remove_repeats(df, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert {tuple(r) for r in got} == brute(rows, window) and len(got) == len(rows)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "dd"] if seed % 2 else [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(10, 40))] for _ in range(5)]
    rows = []
    for i in range(n):
        w = []
        while rng.random() < 0.8:
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.2:
                w += [rng.choice(vocabulary)] * rng.randint(2, 40)
        rows.append((i * 3, rng.choice([" ", "\n", "\t  "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    check(spark, random_rows(seed))


def test_short_window(spark):
    check(spark, random_rows(8), window=3)


def test_unusual_rows(spark):
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (1, "one"), (9, long), (12, "y " + long + " z"), (13, long), (14, "a " * 500), (15, "a " * 700)]
    check(spark, rows)
    assert rc.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in rc.remove_repeats(twice).collect()] == [(1, 1, 0)]


def test_equal_windows_have_equal_marks():
    rng = random.Random(1)
    for _ in range(200):
        core = [rng.choice("abcdefgh") for _ in range(13)]
        marks = set()
        for _ in range(6):
            left, right = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for _ in range(2))
            w = words_of(pa.array([" ".join(left + core + right)]))
            starts, names = rc.window_marks(w, 13)
            marks.add(int(names[np.flatnonzero(starts == len(left))[0]]))
        assert len(marks) == 1


def test_pipeline_form(spark):
    core = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "top " + core, "en", "s", 1), (2, "new words here\n" + core + "\nand more", "en", "s", 1), (3, core, "en", "s", 1), (4, "", "en", "s", 0), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_removed", F.lit(9)).withColumn("kept_text", F.lit("k"))
    got = {r.doc_id: r for r in rc.drop_repeated_passages(docs).collect()}
    assert all(r.n_removed == 9 and r.kept_text == "k" for r in got.values())
    assert set(got) == {1, 2, 4, 5} and got[2].text == "new words here\nand more" and got[2].n_chars == 23
    assert got[1].text == rows[0][1] and got[5].text is None
