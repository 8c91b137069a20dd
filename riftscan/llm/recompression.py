"""Repeated word windows across documents, found by recompression.

A window is ``window`` consecutive words of one document. A window is a repeat in a document if its word
sequence also starts in a document with a smaller id. Words covered by a repeat can be removed or cut out.

Method. Each document's words are recompressed in two rounds: runs of one word become one symbol, then symbols
of a left class that stand before a symbol of a right class become pair symbols, then pairs of those again.
Classes and names are hashes of contents, so all tasks give equal substrings equal names without asking each
other, and every symbol knows the range of words its cut depends on. A symbol whose range lies inside a window
is cut alike wherever that window's words stand; of these the one with the smallest name stands for the window
(or the window itself, if it has none). The rounds over the cluster then ask which names more than one document
has, and only windows with such a name are compared, by 80-bit names of all their words, inside groups that are named by more bits of them.

Nulls: a null id is left out, a null or empty text has no words. Repeated rows of one id count as one document
(the row with the largest text stays); equal texts under different ids are repeats of the smallest id. Very long
documents are worked on as one slice of their own. An empty table gives an empty result. Extra columns, also
with clashing names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import buckets_for, cuts, flat, named_as, one_row_per_id, partitions, plain_names, shared_keys, short_keys, stored
from .text import Ranges, Words, as_lists, mix, salted, slices, words_of

#: Bytes of text that one group of windows comes from, on average.
GROUP_BYTES = 16 << 20
#: Bytes of text whose arrays are worked on at once: they stay in the processor's cache.
PIECE_BYTES = 512 << 10


def _join(symbols: dict[str, np.ndarray], paired: np.ndarray, names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """One symbol fewer for each i in ``paired``, which swallows i + 1."""
    keep = np.ones(len(names), bool)
    keep[paired + 1] = False
    return {"name": names[keep], "doc": symbols["doc"][keep], "lo": lo[keep], "hi": hi[keep]}


def _pair_round(s: dict[str, np.ndarray], salt: int) -> dict[str, np.ndarray]:
    """Left-class symbols before right-class symbols become pairs; an unpaired one depends on the neighbour that kept it so."""
    name, doc, n = s["name"], s["doc"], len(s["name"])
    left = (salted(name, salt) & np.uint64(1)).astype(bool)
    same = doc[1:] == doc[:-1]
    paired = np.flatnonzero(left[:-1] & ~left[1:] & same)
    names = salted(name, salt + 1)
    other = np.where(left, np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0))
    far = np.int64(1) << 60
    alone = (doc[other] != doc) | (other == np.arange(n))
    lo = np.where(alone & ~left, -far, np.minimum(s["lo"], s["lo"][other]))
    hi = np.where(alone & left, far, np.maximum(s["hi"], s["hi"][other]))
    lo[paired], hi[paired] = (f(s[k][paired], s[k][paired + 1]) for f, k in ((np.minimum, "lo"), (np.maximum, "hi")))
    names[paired] = mix(salted(name[paired], salt + 2) * np.uint64(3) + salted(name[paired + 1], salt + 3))
    return _join(s, paired, names, lo, hi)


def symbols_of(w: Words) -> dict[str, np.ndarray]:
    """Symbols after the run round and two pair rounds: name, document, and first and last word they depend on."""
    n = len(w.name)
    if not n:
        return {"name": w.name, "doc": w.doc, "lo": w.doc, "hi": w.doc}
    head = np.concatenate([[True], (w.name[1:] != w.name[:-1]) | (w.doc[1:] != w.doc[:-1])])
    first = np.flatnonzero(head)
    count = np.diff(np.concatenate([first, [n]]))
    doc = w.doc[first]
    far = np.int64(1) << 60
    inner = doc[1:] == doc[:-1]
    lo = np.where(np.concatenate([[False], inner]), first - 1, -far)
    hi = np.where(np.concatenate([inner, [False]]), first + count, far)
    runs = {"name": salted(w.name[first] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 11), "doc": doc, "lo": lo, "hi": hi}
    return _pair_round(_pair_round(runs, 21), 31)


def window_starts(w: Words, window: int) -> np.ndarray:
    """Indexes of words that begin a whole window inside their document."""
    if len(w.name) < window:
        return np.zeros(0, np.int64)
    at = np.arange(len(w.name) - window + 1)
    return at[w.doc[at] == w.doc[at + window - 1]]


def window_marks(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows, and the name of the symbol that stands for each."""
    starts = window_starts(w, window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    ranges = Ranges(w.name, 5)
    s = symbols_of(w)
    inside = (s["lo"] >= 0) & (s["hi"] - s["lo"] < window) & (s["hi"] < len(w.name))
    name, lo, hi = s["name"][inside], s["lo"][inside], s["hi"][inside]
    name = mix(name + ranges.hashes(lo, hi + 1))
    none = np.uint64(2**64 - 1)
    best = np.full(len(w.name), none)
    for k in range(window):
        at = hi - window + 1 + k
        if not (at <= lo).any():
            break
        fits = (at <= lo) & (at >= 0)
        np.minimum.at(best, at[fits], name[fits])
    best = best[starts]
    bare = best == none
    best[bare] = ranges.hashes(starts[bare], starts[bare] + window)
    return starts, best


def _marks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                w = words_of(piece.column("text"))
                starts, names = window_marks(w, window)
                doc = w.doc[starts]
                order = np.lexsort((names, doc))
                doc, names = doc[order], names[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (names[1:] != names[:-1])
                doc, names = doc[fresh], names[fresh]
                cut = np.searchsorted(doc, np.arange(w.docs + 1))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), as_lists(names, cut, pa.int64())], ["owner", "keys"])
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each whole document: number of words, the digest of its words joined by single spaces."""
    for batch in batches:
        for piece in slices(batch, "text", PIECE_BYTES):
            count, digest = [], []
            for text in piece.column("text").cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                count.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(count, pa.int64()), pa.array(digest)],
                                             ["doc_id", "n_words", "sha256"])


_ASKS = "bucket long, one array<long>, two array<short>, docs array<long>, starts array<int>, counts array<int>"


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: document, first start, length."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(head)
    return doc[first], start[first].astype(np.int32), np.diff(np.concatenate([first, [len(doc)]])).astype(np.int32)


def _asks(window: int, buckets: int, marked: int):
    """Windows of candidates: in a slice all but the smallest document's are repeats; that one's are asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", PIECE_BYTES):
                w = words_of(piece.column("text"))
                starts, names = window_marks(w, window)
                lists = piece.column("keys")
                wanted = np.asarray(lists.flatten()).view(np.uint64)
                of = np.repeat(np.arange(piece.num_rows), np.diff(np.asarray(lists.offsets))).astype(np.uint64)
                salt = np.uint64(0x9E3779B97F4A7C15)
                own = short_keys(names, marked).view(np.uint64)
                hit = np.isin(mix(own ^ (w.doc[starts].astype(np.uint64) * salt)), mix(wanted ^ (of * salt)))
                starts, own = starts[hit], own[hit]
                if not len(starts):
                    continue
                doc = np.asarray(piece.column("doc_id"))[w.doc[starts]]
                one, two = (Ranges(w.name, k).hashes(starts, starts + window) for k in (7, 8))
                at = (starts - w.first[w.doc[starts]]).astype(np.int32)
                order = np.lexsort((doc, one))
                sorted_one, sorted_doc = one[order], doc[order]
                head = np.concatenate([[True], sorted_one[1:] != sorted_one[:-1]])
                repeat = np.empty(len(doc), bool)
                repeat[order] = sorted_doc > sorted_doc[head][np.cumsum(head) - 1]
                # Equal in the first name only: ask as well, the second one decides.
                repeat[order] &= two[order] == two[order][head][np.cumsum(head) - 1]
                # Windows that one symbol stands for go to one group, where they are runs again.
                yield _ask_rows((mix(own) % np.uint64(buckets)).astype(np.int64)[~repeat], doc[~repeat], at[~repeat], one[~repeat], two[~repeat])
                if repeat.any():
                    doc, at, count = _runs(doc[repeat], at[repeat])
                    yield _ask_rows(-1 - (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), doc, at, count=count)
    return run


def _ask_rows(bucket, doc, at, one=None, two=None, count=None) -> pa.RecordBatch:
    order = np.lexsort((at, doc, bucket))
    cut = cuts(bucket[order])
    nothing = np.zeros(len(cut), np.int64)

    def lists(values, kind):
        return as_lists(np.zeros(0, np.int64), nothing, kind) if values is None else as_lists(values[order], cut, kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[order][cut[:-1]]), lists(one, pa.int64()), lists(None if two is None else two.astype(np.int16), pa.int16()),
         lists(doc, pa.int64()), lists(at, pa.int32()), lists(count, pa.int32())], ["bucket", "one", "two", "docs", "starts", "counts"])


def _repeats(table: pa.Table) -> pa.Table:
    """Runs of starts of repeats in each document, from the windows of one group."""
    doc, at = flat(table, "docs"), flat(table, "starts")
    if table.column("bucket")[0].as_py() >= 0:
        one, two = flat(table, "one"), flat(table, "two")
        order = np.lexsort((doc, two, one))
        one, two, doc, at = one[order], two[order], doc[order], at[order]
        head = np.ones(len(doc), bool)
        head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        told = doc > doc[head][np.cumsum(head) - 1]
        doc, at, count = _runs(doc[told], at[told])
    else:
        count = flat(table, "counts")
    return pa.table({"doc_id": doc, "start": at, "count": count})


def repeated_windows(docs: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """(stats, repeats). stats: doc_id, n_words, sha256, copy_of (smallest id with the same words). repeats: doc_id, text
    and runs of starts (word indexes) of its repeats (starts, counts), for documents that have
    some and are no copies."""
    docs = one_row_per_id(docs, "doc_id", "text")
    stats = stored(docs.mapInArrow(_digests, "doc_id long, n_words long, sha256 string"))
    least = stored(stats.groupBy("sha256").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")).where("copies > 1"))
    stats = stored(stats.join(least, "sha256", "left").select(
        "doc_id", "n_words", "sha256", F.coalesce("copy_of", "doc_id").alias("copy_of")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    marks = docs.mapInArrow(_marks(window), "owner long, keys array<long>")
    marked = buckets_for(docs, (size or 0) / 30)
    shared = shared_keys(marks, marked)
    alone = stats.where("doc_id = copy_of").select("doc_id")
    candidates = stored(docs.join(shared.withColumnRenamed("owner", "doc_id").join(alone, "doc_id"), "doc_id"))
    buckets = max(partitions(docs), int((size or 0) / GROUP_BYTES) + 1)
    asks = candidates.mapInArrow(_asks(window, buckets, marked), _ASKS)
    runs = asks.groupBy("bucket").applyInArrow(_repeats, "doc_id long, start int, count int")
    starts = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs")).select(
        "doc_id", F.col("runs.start").alias("starts"), F.col("runs.count").alias("counts"))
    return stats, candidates.select("doc_id", "text").join(starts, "doc_id")


def covered(starts: np.ndarray, counts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window of one of the runs of starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _cut(window: int):
    """What is left of each document: words joined by single spaces (digest), and the text without the covered spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digest, rest = [], [], []
            for piece in slices(batch, "text", PIECE_BYTES):
                w = words_of(piece.column("text"))
                starts, counts = (np.asarray(piece.column(c).flatten()) for c in ("starts", "counts"))
                cut = np.asarray(piece.column("starts").offsets) - piece.column("starts").offsets[0].as_py()
                for i in range(piece.num_rows):
                    a, b = w.first[i], w.first[i + 1]
                    runs = slice(cut[i], cut[i + 1])
                    gone = covered(starts[runs], counts[runs], b - a, window)
                    start, end = w.start[a:b], w.end[a:b]
                    kept = [w.data[s:e].tobytes() for s, e in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True)]
                    removed.append(int(gone.sum()))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    edge = np.diff(np.concatenate([[False], ~gone, [False]]).astype(np.int8))
                    rest.append(b"\n".join(w.data[start[s]:end[e - 1]].tobytes() for s, e in
                                           zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(digest), pa.array(rest, pa.binary()).cast(pa.string())],
                ["doc_id", "n_removed", "kept_sha256", "kept_text"])
    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces), kept_text.

    kept_text is null where nothing was removed: the document's own text stands. Otherwise it holds what lies between
    the removed spans, as written, one line for each.
    """
    stats, repeats = repeated_windows(docs, window)
    cut = repeats.mapInArrow(_cut(window), "doc_id long, n_removed long, kept_sha256 string, kept_text string")
    copy = (F.col("copy_of") < F.col("doc_id")) & (F.col("n_words") >= window)
    return stats.join(cut, "doc_id", "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def drop_repeated_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without repeated passages: later copies of a passage go, n_chars follows the text.

    A document of which no word is left goes; one that had none to begin with stays as it is.
    """
    named, docs = docs, plain_names(docs, "doc_id", "text", "n_chars")
    found = remove_repeats(docs, window).where("n_removed > 0").select(
        "doc_id", (F.col("n_removed") == F.col("n_words")).alias("__none_left"), F.col("kept_text").alias("__kept_text"))
    joined = docs.join(found, "doc_id", "left").where("not coalesce(__none_left, false)")
    kept = F.col("__kept_text")
    out = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(kept.isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)
    return named_as(joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns)), named)
