"""Language-model scores: every segmentation of a word into subwords counts.

Tokens are words (A-Z lower-cased) and one end for each text. A vocabulary of pieces is laid over the bytes of " word",
and the forward recursion (in logarithms) sums over all paths. The first piece comes from the pieces that begin a word, each
further one from the others, and a word stops after a piece with a learned probability, so the lattice is a proper
distribution over words: their product over a text is ``score``. Pieces' weights start from the vocabulary's own scores (a
piece of score -r weighs 1 / (r + 50)) and are re-estimated from all training words by expected counts. All 256 bytes are
pieces, so no text is impossible. ``mixed_score`` takes a word's absolute discounted training count as one more path beside
its lattice, which is likelier for words that training has.

A word of any length is walked in stretches of positions; beside one number for each byte nothing of it is held.

Words are counted over all documents. The most frequent ones (at most HEAVY_WORDS, a proven bound) travel to every
task; a document's other words meet the word table in one join on their names, none of which can be hot.

Nulls: a null id is left out; a null or empty text is one end token. Rows that repeat an id count once (the largest
text). Without training words both scores are the lattice's. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import one_row_per_id, stored
from .text import Lookup, Powers, as_lists, bytes_of, once, slices, words_of

#: Words that travel to every task.
HEAVY_WORDS = 1 << 20
#: Share of a class of pieces that the byte pieces hold before training.
BYTE_SHARE = 1e-3
#: Weight of the vocabulary's own scores against expected counts, in pieces.
PRIOR_COUNT = 200.0
_POWERS = Powers(0xA0761D6478BD642F)
_CELLS = 1 << 18
#: Bytes whose pieces are looked up at once.
_ARC_CELLS = 1 << 15


def pieces_of(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading mark is a space) and their prior weights; the last 256 are the bytes."""
    return once(("pieces", path), lambda: _pieces(path))


def _pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:] and len(piece) > 1:
                weights.setdefault(piece, 1 / (50 - model.get_score(i)))
    out = list(weights)
    prior = np.array([*weights.values(), *[0.0] * 256])
    starts = np.array([p[:1] == b" " for p in out] + [b == 32 for b in range(256)])
    for kind in (starts, ~starts):
        prior[kind] /= max(prior[kind].sum(), 1e-300)
        of_bytes = kind & (np.arange(len(prior)) >= len(out))
        prior[kind] *= 1 - BYTE_SHARE
        prior[of_bytes] += BYTE_SHARE / of_bytes.sum()
    return out + [bytes([b]) for b in range(256)], prior


class Lattice:
    """Pieces over words' bytes, with the logarithms of their weights."""

    def __init__(self, path: str, weights: np.ndarray | None = None, stop: float = 0.3) -> None:
        self.pieces, self.prior = pieces_of(path)
        self.starts = np.array([p[:1] == b" " for p in self.pieces])
        weights = self.prior if weights is None else weights
        self.log = np.log(np.where(self.starts, weights, weights * (1 - stop)))
        self.log_or_none = np.append(self.log, -np.inf)  # piece -1 is none
        self.log_stop = np.log(stop)
        self.lookup = _lookup_of(self.pieces)
        self.sizes = sorted({len(p) for p in self.pieces})

    @staticmethod
    def blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of a column as (indexes, byte matrix with a leading space, lengths), of like length."""
        data, offsets = bytes_of(column)
        length = np.diff(offsets) + 1
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            rows = max(1, _CELLS // int(length[order[at]] + 1))
            rows = max(1, min(rows, int(np.searchsorted(length[order[at:]], 1.3 * length[order[at]] + 2, "right"))))
            index = order[at:at + rows]
            size = length[index]
            where = np.arange(size.max() - 1)
            matrix = np.zeros((len(index), int(size.max())), np.uint8)
            matrix[:, 0] = 32
            inside = where < (size - 1)[:, None]
            matrix[:, 1:][inside] = data[(offsets[index][:, None] + where)[inside]]
            yield index, matrix, size
            at += rows

    def _sums(self, matrix: np.ndarray) -> np.ndarray:
        """Prefix sums (position by word) from which every stretch's name follows."""
        size = matrix.shape[1]
        power, _ = _POWERS.upto(size + 1)
        sums = np.zeros((size + 1, len(matrix)), np.uint64)
        np.cumsum((matrix.T.astype(np.uint64) + np.uint64(1)) * power[:size, None], axis=0, out=sums[1:])
        return sums

    def _arcs(self, sums: np.ndarray, low: int, high: int, by_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of which there are pieces that start, or end, at low to high - 1, and these pieces (or -1): (position, length, word)."""
        size = len(sums) - 1
        _, inverse = _POWERS.upto(size + 1)
        lengths, layers = [], []
        for k in self.sizes:
            shift = k if by_end else 0
            first, last = max(low - shift, 0), min(high - shift, size - k + 1)
            if first < last:
                names = (sums[first + k:last + k] - sums[first:last]) * inverse[first:last, None] + np.uint64(k)
                found = self.lookup.find(names.ravel()).reshape(names.shape)
                if found.max() >= 0:
                    lengths.append(k)
                    layers.append((first + shift - low, found))
        out = np.full((high - low, len(lengths), sums.shape[1]), -1, np.int32)
        for j, (at, found) in enumerate(layers):
            out[at:at + len(found), j] = found
        return np.array(lengths), out

    def _stretches(self, sums: np.ndarray) -> list[tuple[int, int]]:
        """Positions in stretches of bounded work, so that a word of any length is walked in bounded memory."""
        size, step = len(sums) - 1, max(1, _ARC_CELLS // sums.shape[1])
        return [(at, min(at + step, size)) for at in range(0, size, step)]

    def forward(self, sums: np.ndarray) -> np.ndarray:
        """Logarithms of the weight of all paths to each position, behind as many empty rows as a piece is long."""
        pad = self.sizes[-1]
        alpha = np.full((pad + len(sums), sums.shape[1]), -np.inf)
        alpha[pad] = 0
        for low, high in self._stretches(sums):
            back, arcs = self._arcs(sums, low + 1, high + 1, by_end=True)
            weight = self.log_or_none[arcs]
            for i in range(high - low):
                at, some = pad + low + 1 + i, np.searchsorted(back, low + 1 + i, "right")
                alpha[at] = _log_sum(alpha[at - back[:some]] + weight[i, :some])
        return alpha

    def log_probabilities(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for index, matrix, size in self.blocks(column):
            alpha = self.forward(self._sums(matrix))
            out[index] = alpha[self.sizes[-1] + size, np.arange(len(size))] + self.log_stop
        return out

    def expected(self, column: pa.Array, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur ``count`` times."""
        out, pad = np.zeros(len(self.pieces)), self.sizes[-1]
        for index, matrix, size in self.blocks(column):
            sums = self._sums(matrix)
            alpha = self.forward(sums)[pad:]
            total = alpha[size, np.arange(len(size))]
            beta = np.full((len(sums) + pad, len(size)), -np.inf)
            beta[size, np.arange(len(size))] = 0
            for low, high in reversed(self._stretches(sums)):
                ahead, arcs = self._arcs(sums, low, high, by_end=False)
                step = self.log_or_none[arcs]
                for i in range(high - low - 1, -1, -1):
                    step[i] += beta[low + i + ahead]
                    beta[low + i] = np.where(size == low + i, 0.0, _log_sum(step[i]))
                step += (alpha[low:high] - total)[:, None]
                there = np.flatnonzero(arcs >= 0)
                uses = np.exp(step.ravel()[there]) * count[index][there % len(index)]
                out += np.bincount(arcs.ravel()[there], uses, len(out))
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over the first axis; without any weight minus infinity."""
    top = np.maximum(x.max(axis=0), -1e300)
    x = x - top
    np.exp(x, out=x)
    with np.errstate(divide="ignore"):
        return top + np.log(x.sum(axis=0))


def _lookup_of(pieces: list[bytes]) -> Lookup:
    keys = []
    for p in pieces:
        power, _ = _POWERS.upto(len(p) + 1)
        keys.append(int(((np.frombuffer(p, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:len(p)]).sum()) + len(p))
    return Lookup(np.array([k % 2**64 for k in keys], np.uint64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a slice, with their numbers in training documents and in all."""
    for batch in batches:
        for piece in slices(batch, "text"):
            w = words_of(piece.column("text"), lower=True)
            if not len(w.name):
                continue
            name, one, of = np.unique(w.name, return_index=True, return_inverse=True)
            train = np.bincount(of, np.asarray(piece.column("train"))[w.doc].astype(float), len(name)).astype(np.int64)
            words = [w.data[s:e].tobytes() for s, e in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(train), pa.array(np.bincount(of, minlength=len(name)))],
                ["name", "word", "train", "total"])


def _expected(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lattice.pieces))
        for batch in batches:
            total += lattice.expected(batch.column("word"), np.asarray(batch.column("train")).astype(float))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "uses"])
    return run


def _trained(words: DataFrame, path: str, rounds: int, n_words: int) -> tuple[np.ndarray | None, float]:
    weights, stop = None, 0.3
    for _ in range(rounds if n_words else 0):
        lattice = Lattice(path, weights, stop)
        uses = np.zeros(len(lattice.pieces))
        rows = words.where("train > 0").select("word", "train").mapInArrow(_expected(lattice), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        for piece, value in rows.collect():  # at most one row for each piece of the vocabulary
            uses[piece] = value
        stop = n_words / (n_words + uses[~lattice.starts].sum() + 1)
        uses += PRIOR_COUNT * lattice.prior
        weights = np.empty(len(uses))
        for kind in (lattice.starts, ~lattice.starts):
            weights[kind] = uses[kind] / uses[kind].sum()
    return weights, stop


def _word_scores(lattice: Lattice, discount: float, n_words: int, unseen: float):
    """Natural logarithms of each word's probability among words: by the lattice, and mixed with its count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = lattice.log_probabilities(batch.column("word"))
            count = np.asarray(batch.column("train"))
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(count - discount, 0) / max(n_words, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "train", "total")), pa.array(spelled), pa.array(np.logaddexp(whole, spelled + np.log(unseen)))],
                                             ["name", "train", "total", "log_p", "log_mixed"])
    return run


def _document_sums(heavy):
    """Sums over a document's frequent words, and its other words with their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, train, log_p, log_mixed = heavy.value
        lookup = Lookup(names)
        log_count = np.log10(train + 0.5)
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words_of(piece.column("text"), lower=True)
                at = lookup.find(w.name)
                doc, got = w.doc[at >= 0], at[at >= 0]
                sums = [np.bincount(doc, v[got], w.docs) for v in ((train > 0).astype(float), log_count, log_p, log_mixed)]
                name, doc = w.name[at < 0], w.doc[at < 0]
                order = np.lexsort((name, doc))
                name, doc = name[order], doc[order]
                head = np.ones(len(name), bool)
                head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(head)
                cut = np.searchsorted(doc[first], np.arange(w.docs + 1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.diff(w.first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(sums[3]),
                     as_lists(name[first], cut, pa.int64()), as_lists(np.diff(np.concatenate([first, [len(name)]])).astype(np.int32), cut, pa.int32())],
                    ["doc_id", "n_words", "known", "counted", "modelled", "mixed", "names", "numbers"])
    return run


def _heavy(scored: DataFrame):
    """The most frequent words' names, training counts and scores: whole steps of frequency, as many as fit."""
    step = F.floor(F.log2("total") * 16)
    sizes = sorted(scored.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, room = None, HEAVY_WORDS
    for s, n in sizes:
        if n > room:
            break
        least, room = s, room - n
    rows = scored.where(step >= least if least is not None else F.lit(False)).select("name", "train", "log_p", "log_mixed").toArrow()
    value = tuple(np.asarray(rows.column(c).combine_chunks()) for c in ("name", "train", "log_p", "log_mixed"))
    heavy = scored.sparkSession.sparkContext.broadcast((value[0].view(np.uint64), *value[1:]))
    return heavy, scored.where(step < least if least is not None else F.lit(True))


def score(docs: DataFrame, pieces: str, train: F.Column | str = "true", rounds: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, mixed_score of every document.

    ``pieces``: path of the vocabulary. ``train``: condition on doc_id for documents that are learned from.
    base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) of every token; score is the lattice's log10 probability, mixed_score that of lattice and counts.
    """
    docs = one_row_per_id(docs, "doc_id", "text")
    train = F.expr(train) if isinstance(train, str) else train
    words = docs.select("text", train.alias("train")).mapInArrow(_counts, "name long, word string, train long, total long")
    words = stored(words.groupBy("name", "word").agg(F.sum("train").alias("train"), F.sum("total").alias("total")))
    ends = docs.where(train).count()
    n_words, distinct, once, twice = (x or 0 for x in words.agg(
        F.sum("train"), F.sum((F.col("train") > 0).cast("long")), F.sum((F.col("train") == 1).cast("long")), F.sum((F.col("train") == 2).cast("long"))).first())
    tokens, kinds = n_words + ends, distinct + (ends > 0)
    discount = min(0.95, max(0.05, once / max(once + 2 * twice, 1)))
    unseen = discount * distinct / n_words if n_words else 1.0
    weights, stop = _trained(words, pieces, rounds, n_words)
    scored = stored(words.mapInArrow(_word_scores(Lattice(pieces, weights, stop), discount, n_words, unseen), "name long, train long, total long, log_p double, log_mixed double"))
    heavy, others = _heavy(scored)
    sums = stored(docs.mapInArrow(
        _document_sums(heavy), "doc_id long, n_words long, known long, counted double, modelled double, mixed double, names array<long>, numbers array<int>"))
    rest = sums.select("doc_id", F.explode(F.arrays_zip("names", "numbers")).alias("w")).select("doc_id", F.col("w.names").alias("name"), F.col("w.numbers").alias("number"))
    rest = rest.join(others, "name").groupBy("doc_id").agg(
        F.sum(F.when(F.col("train") > 0, F.col("number")).otherwise(0)).alias("known_rest"),
        F.sum(F.col("number") * F.log10(F.col("train") + 0.5)).alias("counted_rest"),
        F.sum(F.col("number") * F.col("log_p")).alias("modelled_rest"),
        F.sum(F.col("number") * F.col("log_mixed")).alias("mixed_rest"))
    both = sums.drop("names", "numbers").join(rest, "doc_id", "left").fillna(0, ["known_rest", "counted_rest", "modelled_rest", "mixed_rest"])
    end = (ends + 0.5) / (tokens + 1)
    base = np.log10(tokens + 0.5 * (kinds + 1))
    of_tokens = F.col("n_words") * float(np.log10(1 - end)) + float(np.log10(end))
    return both.select(
        "doc_id", (F.col("n_words") + 1).alias("n_tokens"), (F.col("known") + F.col("known_rest") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("counted") + F.col("counted_rest") + float(np.log10(ends + 0.5)) - (F.col("n_words") + 1) * float(base)).alias("base_score"),
        ((F.col("modelled") + F.col("modelled_rest")) / float(np.log(10)) + of_tokens).alias("score"),
        ((F.col("mixed") + F.col("mixed_rest")) / float(np.log(10)) + of_tokens).alias("mixed_score"))
