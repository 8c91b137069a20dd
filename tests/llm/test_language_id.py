"""Languages: accuracy on held-out texts, spans of mixed texts, Viterbi against all paths."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riftscan.llm import language_id as li

HELD = "crc32(cast(doc_id as string)) % 5 = 0"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = [5, 0, 1, 6, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(0, 4, (first[-1], 3))
    got = li.viterbi(scores, first, 3.0)
    for a, b in zip(first, first[1:], strict=False):
        def value(path, a=a):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 3.0 * sum(x != y for x, y in itertools.pairwise(path))
        if b > a:
            assert np.isclose(value(got[a:b]), max(map(value, itertools.product(range(3), repeat=b - a))))


def test_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = li.train(docs.where(f"not ({HELD})"))
    got = li.identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where(HELD)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    one = {r.lang: r.text for r in docs.where("n_chars > 300").select("lang", "text").collect()}
    mixed = spark.createDataFrame([(1, one["en"] + "\n" + one["de"])], "doc_id long, text string")
    spans = [s.lang for s in li.identify(mixed, model).first().spans if s.words > 5]
    assert "en" in spans and "de" in spans


def test_unusual_rows(spark):
    train = spark.createDataFrame([("the cat", "en"), ("der Hund", "de"), ("мир труд", "ru"), (None, "en"), ("x", None)], "text string, lang string")
    model = li.train(train)
    rows = [(1, None), (2, ""), (3, "123 ... —"), (4, "the the cat"), (5, "труд"), (6, "der " * 30_000), (None, "der Hund"), (4, "the the cat"), (7, "漢字")]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got if r.doc_id != 7) == [
        (0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "ru"), (6, "de")]
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 9
    nothing = li.train(train.limit(0))
    assert {r.lang_pred for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string"), nothing).collect()} == {"und"}


def test_scripts():
    assert {li.SCRIPT_NAMES[li.scripts_of(np.array([next(p for p in range(low, high + 1) if chr(p).isalpha())]))[0]] == name
            for name, low, high in li.SCRIPTS} == {True}
    texts = {"word": "latin", "ÀÉ": "latin", "Ԁԥ": "cyrillic", "Աբ": "armenian", "हिन्दी": "devanagari", "বাংলা": "bengali", "漢字": "han", "かな": "kana",
             "𠀀𠀁": "han", "Ꭰ": "cherokee", "ⵣ": "other", "。。": "", "×÷": "", "٣": "", "१२": "", "😀": ""}
    for text, want in texts.items():
        g = li.grams_of(pa.array([f" {text}. "]))
        assert li.SCRIPT_NAMES[g.scripts.sum(axis=0).argmax()] == want and g.scripts.sum() == sum(map(str.isalpha, text)), text


def brute(text, model, penalty):
    """Grams, narrowing, all paths and letters by plain Python."""
    words = ["".join(c.lower() if c.isascii() else c for c in w).encode() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    scores, letters = [], []
    for w in words:
        padded, total = b" " + w + b"  ", np.zeros(len(model.languages))
        for i in range(len(w)):
            three = sum(b << 8 * k for k, b in enumerate(padded[i:i + 3])) * 0x9E3779B1 % 2**32 >> 32 - li.BITS
            total = total + model.log[three]
            if i + 1 < len(w):
                four = sum(b << 8 * k for k, b in enumerate(padded[i:i + 4])) * 0x85EBCA6B % 2**32 >> 32 - li.BITS
                total = total + model.log[four + (1 << li.BITS)]
        mine = [int(li.scripts_of(np.array([ord(c)]))[0]) for c in w.decode() if c.isalpha()]
        script = max(sorted(set(mine)), key=mine.count) if mine else 0
        allowed = model.allowed[script]
        scores.append(np.where(allowed, total, total + li._OUT) if script and allowed.any() else total)
        letters.append(len(mine))
    if not sum(letters):
        return "und", 0.0
    n = range(len(model.languages))
    best = max(itertools.product(n, repeat=len(words)), key=lambda path: sum(s[x] for s, x in zip(scores, path, strict=True))
               - penalty * sum(x != y for x, y in itertools.pairwise(path)))
    share = [sum(k for k, x in zip(letters, best, strict=True) if x == lang) for lang in n]
    return model.languages[int(np.argmax(share))], max(share) / sum(letters)


def test_whole_predictions(spark):
    rows = [("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("мир и труд", "ru"), ("le chat et la souris", "fr")]
    model = li.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = ["the Hund", "la souris sat", "мир the труд", "12 et -- 7", "Katze", "。。。", "× ÷", "٣", "१२", "😀 !", "", "a\tb", "ДА and", "é", "漢字 the", "x" * 9]
    got = {r.doc_id: r for r in li.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        lang, score = brute(text, model, li.SWITCH_PENALTY)
        assert (got[k].lang_pred, round(got[k].score, 4)) == (lang, round(score, 4)), text
