"""Toxicity of texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of lexicon words (plain, weighted, distinct, first and last third), nearness of lexicon
words to the second person, capitals, punctuation and obfuscation (digits and signs inside words), and length. The
lexicon is learned: words whose share of toxic training documents stands out (LEXICON_Z deviations of the log odds).
Everything is fitted on at most MAX_ROWS labelled documents, those with the smallest hashes of their ids; that bound
is a parameter of ``train``. One fifth of them is kept from the trees and calibrates the scores.

A null or empty text has zero densities and gets a score like any other. A null id stays; repeated rows repeat their
result; a document labelled more than once counts as toxic if one label says so; null labels are left out. Without
labels of both kinds every score is the share of toxic labels (0 without any). A very long text is a slice of its own.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import columns_of, named_as, plain_names
from .text import Lookup, bytes_of, slices, words_of

MAX_ROWS = 20_000
LEXICON_Z = 4.5
LEXICON_SIZE = 1000
#: Words between a lexicon word and the second person that still count as near.
NEAR = 5
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
_PIECE = 512 << 10

# Words of the second person in the languages served.
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos "
                 "tú ti tus usted ustedes vosotros").split()

#: Bytes that don't belong to a word: ASCII signs, except those that stand for letters inside words.
_OUTSIDE = np.array([not (b >= 128 or chr(b).isalnum() or chr(b) in "@$*") for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_ODD = np.array([48 <= b <= 57 or chr(b) in "@$*" for b in range(256)])

FEATURES = ("hits", "weighted", "distinct", "any", "head", "tail", "near", "near_share", "capitals", "capital_words",
            "exclamations", "questions", "signs", "obfuscated", "stars", "words", "word_length")


@dataclass
class Model:
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] | None = None
    constant: float | None = None


def _names(words: list[str]) -> np.ndarray:
    return words_of(pa.array([" ".join(words)]), True, _OUTSIDE).name


def features(column: pa.Array, names: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = words_of(column, False, _OUTSIDE)
    low = words_of(column, True, _OUTSIDE)
    docs, n = w.docs, np.maximum(np.diff(w.first), 1)
    out = np.zeros((docs, len(FEATURES)))
    at = Lookup(names).find(low.name) if len(names) else np.full(len(w.name), -1)
    hit = np.flatnonzero(at >= 0)
    doc = w.doc[hit]
    count = np.bincount(doc, minlength=docs)
    place = (hit - w.first[doc]) / n[doc]
    pairs = np.unique(doc * np.int64(max(len(names), 1)) + at[hit]) // max(len(names), 1)
    second = np.flatnonzero(Lookup(np.unique(_names(SECOND_PERSON))).find(low.name) >= 0)
    gap = np.full(len(hit), 1e9)
    if len(second) and len(hit):
        right = np.searchsorted(second, hit)
        for k in (np.maximum(right - 1, 0), np.minimum(right, len(second) - 1)):
            gap = np.where(w.doc[second[k]] == doc, np.minimum(gap, np.abs(second[k] - hit)), gap)
    sums = np.zeros((6, len(w.data) + 1), np.int32)
    for k, of in enumerate((_UPPER, _LETTER, _ODD)):
        np.cumsum(of[w.data], out=sums[k, 1:])
    for k, sign in enumerate(b"!?*"):
        np.cumsum(w.data == sign, out=sums[3 + k, 1:])
    offsets = bytes_of(column)[1]
    whole = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
    size = np.maximum(np.diff(offsets), 1)
    upper, letters, odd = (sums[k, w.end] - sums[k, w.start] for k in range(3))
    out[:, 0] = count / n
    out[:, 1] = np.bincount(doc, weights[at[hit]] if len(hit) else None, docs) / n
    out[:, 2] = np.bincount(pairs, minlength=docs)
    out[:, 3] = np.bincount(doc, weights[at[hit]] if len(hit) else None, docs)
    out[:, 4] = np.bincount(doc[place < 1 / 3], minlength=docs)
    out[:, 5] = np.bincount(doc[place >= 2 / 3], minlength=docs)
    out[:, 6] = np.bincount(doc, 1 / (1 + gap), docs)
    out[:, 7] = np.bincount(doc[gap <= NEAR], minlength=docs) / np.maximum(count, 1)
    out[:, 8] = whole[0] / np.maximum(whole[1], 1)
    out[:, 9] = np.bincount(w.doc[(upper > 1) & (upper == letters)], minlength=docs) / n
    out[:, 10], out[:, 11], out[:, 14] = whole[3] / size, whole[4] / size, whole[5] / size
    out[:, 12] = (size - whole[1]) / size
    out[:, 13] = np.bincount(w.doc[(odd > 0) & (letters > 0)], minlength=docs) / n
    out[:, 15] = np.log1p(np.diff(w.first))
    out[:, 16] = whole[1] / n
    return out


def _lexicon_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each labelled document."""
    for batch in batches:
        for piece in slices(batch, "text", _PIECE):
            w = words_of(piece.column("text"), True, _OUTSIDE)
            toxic = np.asarray(piece.column("toxic"))
            order = np.lexsort((w.name, w.doc))
            name, doc = w.name[order], w.doc[order]
            fresh = np.ones(len(name), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            name, label = name[fresh], toxic[doc[fresh]]
            one, of = np.unique(name, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(np.bincount(of, label, len(one)).astype(np.int64)), pa.array(np.bincount(of, 1 - label, len(one)).astype(np.int64))],
                ["name", "toxic", "clean"])


def _feature_rows(names: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                x = features(piece.column("text"), names, weights)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("toxic"), piece.column("held"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "held", "x"])
    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of DEPTH levels: feature and bin of every inner node, value of every leaf."""
    split, cut = np.zeros(2 ** DEPTH - 1, int), np.full(2 ** DEPTH - 1, BINS)
    node = np.zeros(len(g), int)
    for level in range(DEPTH):
        low, width = 2 ** level - 1, 2 ** level
        gains = np.full((width, binned.shape[1], BINS), -np.inf)
        for f in range(binned.shape[1]):
            at = (node - low) * BINS + binned[:, f]
            sg, sh, sn = (np.bincount(at, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h, np.ones(len(g))))
            tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
            gain = sg ** 2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg ** 2 / (th + 1)
            gains[:, f] = np.where((sn >= 8) & (tn - sn >= 8), gain, -np.inf)
        flat = gains.reshape(width, -1)
        best = flat.argmax(axis=1)
        good = flat[np.arange(width), best] > 1e-6
        split[low:low + width] = np.where(good, best // BINS, 0)
        cut[low:low + width] = np.where(good, best % BINS, BINS)
        node = 2 * node + 1 + (binned[np.arange(len(g)), split[node]] > cut[node])
    leaf = node - (2 ** DEPTH - 1)
    return split, cut, np.bincount(leaf, g, 2 ** DEPTH) / (np.bincount(leaf, h, 2 ** DEPTH) + 1) * RATE


def _raw(model: Model, x: np.ndarray) -> np.ndarray:
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(model.edges)], axis=1)
    out = np.full(len(x), model.base)
    for split, cut, value in model.trees:
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[np.arange(len(x)), split[node]] > cut[node])
        out += value[node - (2 ** DEPTH - 1)]
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y: last x of each step, and its value."""
    order = np.argsort(x, kind="stable")
    xs, where = np.unique(x[order], return_inverse=True)
    weight, value = np.bincount(where).astype(float), np.bincount(where, y[order])
    stack: list[list[float]] = []
    for k in range(len(xs)):
        stack.append([xs[k], weight[k], value[k]])
        while len(stack) > 1 and stack[-2][2] * stack[-1][1] >= stack[-1][2] * stack[-2][1]:
            last = stack.pop()
            stack[-1] = [last[0], stack[-1][1] + last[1], stack[-1][2] + last[2]]
    return np.array([s[0] for s in stack]), np.array([(s[2] + 0.5) / (s[1] + 1) if s[2] in (0, s[1]) else s[2] / s[1] for s in stack])


def _probability(model: Model, x: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    raw = _raw(model, x)
    last, value = model.steps
    step = value[np.minimum(np.searchsorted(last, raw, "left"), len(last) - 1)]
    # Inside a step the trees' own order stays, within a hundredth.
    return np.clip(0.99 * step + 0.01 * _sigmoid(raw), 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, lexicon_size: int = LEXICON_SIZE, least_docs: int = 3) -> Model:
    """From the labelled documents among ``docs``: labels has doc_id and toxic (0 or 1).

    A fifth of them, by a hash of the id, calibrates the scores; lexicon and trees come from the others alone. The lexicon
    takes at most ``lexicon_size`` words that ``least_docs`` toxic documents have.
    """
    labels = columns_of(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    labels = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    sample = labels.orderBy(F.crc32(F.concat(F.lit("toxic"), F.col("doc_id").cast("string"))), "doc_id").limit(max_rows)
    held = F.crc32(F.concat(F.lit("held"), F.col("doc_id").cast("string"))) % 5 == 0
    known = columns_of(docs, "doc_id", "text").join(F.broadcast(sample.withColumn("held", held)), "doc_id")  # at most max_rows rows
    counts = {r["held"]: (r["n"], r["t"]) for r in known.groupBy("held").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    (fit_n, fit_t), (held_n, held_t) = (counts.get(h, (0, 0)) for h in (False, True))
    if not 0 < fit_t < fit_n or not 0 < held_t < held_n:  # too few to hold any back
        known = known.withColumn("held", F.lit(False))
        fit_n, fit_t = fit_n + held_n, fit_t + held_t
    total, toxic = fit_n, fit_t
    if not 0 < toxic < total:
        return Model(constant=toxic / max(total, 1))
    words = known.where("not held").mapInArrow(_lexicon_words, "name long, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = (F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (total - toxic - F.col("b") + 0.5)))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (toxic - F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (total - toxic - F.col("b") + 0.5))
    lexicon = words.where(F.col("a") >= least_docs).select("name", odds.alias("odds"), (odds / error).alias("z")).where(F.col("z") >= LEXICON_Z).orderBy(F.desc("z"), "name").limit(lexicon_size).collect()
    model = Model(np.array([r.name for r in lexicon], np.int64).view(np.uint64), np.array([r.odds for r in lexicon], float))
    rows = known.mapInArrow(_feature_rows(model.names, model.weights), "doc_id long, toxic long, held boolean, x array<double>").toArrow()
    order = np.argsort(np.asarray(rows.column("doc_id").combine_chunks()), kind="stable")
    x = np.array(rows.column("x").to_pylist(), float)[order]
    y = np.asarray(rows.column("toxic").combine_chunks()).astype(float)[order]
    held = np.asarray(rows.column("held").combine_chunks())[order]
    fit = ~held
    model.edges = [np.unique(np.quantile(x[fit, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[fit, f], "left") for f, e in enumerate(model.edges)], axis=1)
    share = y[fit].mean()
    model.base = float(np.log(share / (1 - share)))
    raw = np.full(int(fit.sum()), model.base)
    for _ in range(TREES):
        p = _sigmoid(raw)
        tree = _grow(binned, y[fit] - p, p * (1 - p))
        model.trees.append(tree)
        raw = raw + _raw(Model(base=0.0, edges=model.edges, trees=[tree]), x[fit])
    use = held if held.any() else fit
    model.steps = isotonic(_raw(model, x[use]), y[use])
    return model


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model.value)
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                p = _probability(m, features(piece.column("text"), m.names, m.weights))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # at most LEXICON_SIZE words and TREES trees
    return columns_of(docs, "doc_id", "text").mapInArrow(_scores(shared), "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without those that the model rejects. A row with a null id is judged by its text like any other."""
    model = docs.sparkSession.sparkContext.broadcast(vars(train(docs, labels, max_rows)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model.value)
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                p = _probability(m, features(piece.column("text"), m.names, m.weights))
                yield piece.filter(pa.array(p < 0.5))
    plain = plain_names(docs, "text")
    return named_as(plain.mapInArrow(keep, plain.schema), docs)
