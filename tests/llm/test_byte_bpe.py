"""Encoding against the library that the rank files are made for, and the round trip."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from riftscan.llm import byte_bpe as bb

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bb.ranks_of(PATH).by_bytes, special_tokens={})


def test_random_texts(library):
    rng = random.Random(3)
    alphabet = "aaabcdefgh  éß中文\n\t12'.s,𝄞"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 2047, "the quick brown fox's", "don't I'll", "é" * 500, "x" + " " * 300 + "y", "\x00\x01"]
    encoder = bb.Encoder(PATH, P.PATTERN)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text)
        assert b"".join(encoder.bytes[i] for i in ids) == text.encode()


def test_tables(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in bb.digest(docs, PATH, P.PATTERN).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_unusual_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (None, "b c", 2), (4, "word " * 60_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text2 int").toDF("doc_id", "text", "text")
    got = bb.encode(docs, PATH, P.PATTERN)
    assert sorted((r.doc_id or 0, r.decoded) for r in got.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert sorted(r.text for r in bb.decode(got, PATH).collect()) == sorted(r[1] or "" for r in rows)
    assert bb.digest(docs.limit(0), PATH, P.PATTERN).count() == 0
