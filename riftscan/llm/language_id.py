"""Languages of texts and of their parts.

A word's script (ranges of its letters' code points) narrows the languages to those that
write at least SCRIPT_SHARE of their letters in it. Each word gets a score for each language: the log probabilities of
its byte 3- and 4-grams with the word's edges. Viterbi over a text's words, with a penalty for every switch, labels
spans of mixed texts; the language with most letters on the path is the text's.

Training counts grams in fixed tables (languages x 2 ** 17 entries), summed over the cluster, so what reaches the
driver doesn't grow with the corpus. Only text and language of training rows are learned from.

A null text, or one without a letter, is `und` with score 0 and no spans; the same holds when nothing was learned.
Null ids stay; repeated rows repeat their result; ties go to the first language in alphabetical order. A very long
text is a slice of its own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import columns_of
from .text import _LOWER, _SPACE, bytes_of, slices

BITS = 16
SCRIPT_SHARE = 0.01
#: Nats that a change of language costs.
SWITCH_PENALTY = 8.0
_PIECE = 1 << 20
_OUT = -1e4

# Ranges of code points and the scripts that they belong to.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xAA, 0xAA), ("latin", 0xBA, 0xBA), ("latin", 0xC0, 0x24F), ("latin", 0x250, 0x2B8),
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("syriac", 0x700, 0x74F), ("arabic", 0x750, 0x77F), ("thaana", 0x780, 0x7BF), ("nko", 0x7C0, 0x7FF), ("arabic", 0x8A0, 0x8FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF),
    ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("cyrillic", 0x1C80, 0x1C8F), ("georgian", 0x1C90, 0x1CBF), ("latin", 0x1D00, 0x1D25), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("latin", 0x2C60, 0x2C7F), ("han", 0x3005, 0x3007), ("kana", 0x3040, 0x30FF), ("bopomofo", 0x3100, 0x312F),
    ("hangul", 0x3130, 0x318F), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("cyrillic", 0xA640, 0xA69F),
    ("latin", 0xA720, 0xA7FF), ("latin", 0xAB30, 0xAB6F), ("hangul", 0xAC00, 0xD7FF), ("han", 0xF900, 0xFAFF), ("latin", 0xFB00, 0xFB06),
    ("hebrew", 0xFB1D, 0xFB4F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F),
    ("han", 0x20000, 0x3FFFD),
)
#: Letters outside all ranges share one script.
SCRIPT_NAMES = ["", *dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]
_LOW = np.array([low for _, low, _ in SCRIPTS])
_HIGH = np.array([high for _, _, high in SCRIPTS])
_NUMBER = np.array([SCRIPT_NAMES.index(name) for name, _, _ in SCRIPTS], np.int8)


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Numbers (in SCRIPT_NAMES) of the scripts of code points; 0 for what Unicode doesn't call a letter."""
    few, of = np.unique(points, return_inverse=True)
    at = np.searchsorted(_LOW, few, "right") - 1
    script = np.where((at >= 0) & (few <= _HIGH[at]), _NUMBER[at], np.int8(len(SCRIPT_NAMES) - 1))
    script[[not chr(p).isalpha() for p in few.tolist()]] = 0
    return script[of]


_ASCII = scripts_of(np.arange(128))
_N_SCRIPTS = len(SCRIPT_NAMES)


def _letters_at(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the bytes at ``at`` begin a letter, and its script."""
    byte = text[at]
    script = np.where(byte < 0x80, _ASCII[byte & 0x7F], np.int8(0))
    wide = np.flatnonzero(byte >= 0xC0)
    p, first = at[wide], byte[wide].astype(np.int64)
    more = [text[np.minimum(p + k, len(text) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    points = np.where(first < 0xE0, (first & 0x1F) << 6 | more[0], np.where(
        first < 0xF0, (first & 0x0F) << 12 | more[0] << 6 | more[1], (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
    script[wide] = scripts_of(points)
    some = np.flatnonzero(script)
    return some, script[some]


@dataclass
class Grams:
    """Grams of a slice in the order of its words."""

    bucket: np.ndarray
    word: np.ndarray
    doc_of_word: np.ndarray
    first_word: np.ndarray
    scripts: np.ndarray  # letters of each script, by word


def grams_of(column: pa.Array) -> Grams:
    data, offsets = bytes_of(column)
    docs = len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    text = np.full(len(data) + docs + 3, 32, np.uint8)
    text[np.arange(len(data)) + 1 + doc] = np.where(_SPACE[data], 32, _LOWER[data])
    inside = text != 32
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    word_at = np.cumsum(np.concatenate([[False], inside[1:] & ~inside[:-1]])) - 1
    first_byte = offsets + np.arange(docs + 1) + 1  # where each document begins
    first_word = np.searchsorted(start, first_byte)
    at = np.flatnonzero(inside[:-2])  # the byte after a gram's first
    wide = text.astype(np.uint32)
    three = (wide[at - 1] | wide[at] << np.uint32(8) | wide[at + 1] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    four_at = inside[at + 1]
    four = ((wide[at - 1] | wide[at] << np.uint32(8) | wide[at + 1] << np.uint32(16) | wide[at + 2] << np.uint32(24))
            * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)
    both = np.stack([three, np.where(four_at, four, np.uint32(2 << BITS))], axis=1).ravel()  # the last bucket counts nothing
    scripts = np.zeros((len(start), _N_SCRIPTS), np.int32)
    some, of = _letters_at(text, at)
    word_of = word_at[at[some]]
    for s in np.unique(of).tolist():
        scripts[:, s] = np.bincount(word_of[of == s], minlength=len(start))
    return Grams(both, np.repeat(word_at[at], 2), np.repeat(np.arange(docs), np.diff(first_word)), first_word, scripts)


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # bucket, language
    allowed: np.ndarray  # script, language


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    size = 2 << BITS
    for batch in batches:
        for piece in slices(batch, "text", _PIECE):
            g = grams_of(piece.column("text"))
            langs = np.array(piece.column("lang").to_pylist(), object)
            of_word = langs[g.doc_of_word] if len(langs) else langs
            of_gram = of_word[g.word]
            for lang in sorted(set(langs)):
                mine = totals.setdefault(lang, np.zeros(size + _N_SCRIPTS, np.int64))
                mine[:size] += np.bincount(g.bucket[of_gram == lang], minlength=size + 1)[:size]
                mine[size:] += g.scripts[of_word == lang].sum(axis=0)
    for lang, counts in totals.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> Model:
    """From rows of (text, lang) without nulls."""
    rows = columns_of(docs, "text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    size = 2 << BITS
    table = np.zeros((size + _N_SCRIPTS, len(languages)))
    where = {x: i for i, x in enumerate(languages)}
    of = np.array([where[x] for x in counts.column("lang").to_pylist()], int)
    table[np.asarray(counts.column("bucket").combine_chunks()), of] = np.asarray(counts.column("n").combine_chunks())
    log = np.zeros((size + 1, len(languages)), np.float32)
    for low in (0, 1 << BITS):
        part = table[low:low + (1 << BITS)]
        log[low:low + (1 << BITS)] = np.log((part + 0.1) / (part.sum(axis=0) + 0.1 * (1 << BITS)))
    scripts = table[size:]
    return Model(languages, log, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def word_scores(g: Grams, model: Model) -> np.ndarray:
    n = len(g.doc_of_word)
    if not n:
        return np.zeros((0, len(model.languages)), np.float32)
    first = np.searchsorted(g.word, np.arange(n))
    scores = np.add.reduceat(model.log[g.bucket], first, axis=0)
    script = g.scripts.argmax(axis=1)
    allowed = model.allowed[script]
    allowed[(script == 0) | ~allowed.any(axis=1)] = True
    scores[~allowed] += _OUT
    return scores


def viterbi(scores: np.ndarray, first_word: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word; all documents of the slice advance together, longest first."""
    length = np.diff(first_word)
    order = np.argsort(-length, kind="stable")
    first, length = first_word[:-1][order], length[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    stays = np.zeros(scores.shape, bool)
    came = np.zeros(len(scores), np.int32)
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    best = scores[first[:alive[0]]].astype(float)
    final = np.zeros(len(first), np.int32)
    for t in range(1, len(alive)):
        if alive[t] < alive[t - 1]:
            final[alive[t]:alive[t - 1]] = best[alive[t]:].argmax(axis=1)
            best = best[:alive[t]]
        at = first[:alive[t]] + t
        top = best.argmax(axis=1)
        switch = best[np.arange(len(best)), top] - penalty
        stay = best >= switch[:, None]
        stays[at], came[at] = stay, top
        best = np.where(stay, best, switch[:, None]) + scores[at]
    final[:alive[-1]] = best.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        at, label = first[:alive[t]] + t, final[:alive[t]]
        labels[at] = label
        if t:
            final[:alive[t]] = np.where(stays[at, label], label, came[at])
    return labels


def _identify(model, penalty: float, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                column = piece.column("text")
                g = grams_of(column)
                if m.languages:
                    labels = viterbi(word_scores(g, m), g.first_word, penalty)
                    letters = g.scripts.sum(axis=1) + 1e-6
                    n = len(m.languages)
                    share = np.bincount(g.doc_of_word * n + labels, letters, piece.num_rows * n).reshape(-1, n)
                    known = np.bincount(g.doc_of_word, g.scripts.sum(axis=1), piece.num_rows) > 0
                    pred = [m.languages[i] if k else "und" for i, k in zip(share.argmax(axis=1), known, strict=True)]
                    score = np.where(known, share.max(axis=1) / np.maximum(share.sum(axis=1), 1e-9), 0.0)
                else:
                    labels, known = np.zeros(len(g.doc_of_word), int), np.zeros(piece.num_rows, bool)
                    pred, score = ["und"] * piece.num_rows, np.zeros(piece.num_rows)
                spans = []
                for i, (a, b) in enumerate(zip(g.first_word, g.first_word[1:], strict=False)):
                    head = np.concatenate([[0], np.flatnonzero(np.diff(labels[a:b])) + 1, [b - a]]) if known[i] else [0]
                    spans.append([{"lang": m.languages[labels[a + s]], "first_word": int(s), "words": int(e - s)} for s, e in zip(head, head[1:], strict=False)])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(spans, kind)], [*keep, "lang_pred", "score", "spans"])
    return run


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language), spans (lang, first_word, words)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log, model.allowed))  # languages x 2 ** 17 numbers
    return columns_of(docs, "doc_id", "text").mapInArrow(
        _identify(shared, penalty, ["doc_id"]),
        "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first_word: long, words: long>>")
