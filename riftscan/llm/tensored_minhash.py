"""Near duplicates by MinHash with tensored banding.

A document's set are the distinct shingles of its words. Two collections of BANDS bands with ROWS minhashes each are
computed, 2 * BANDS * ROWS hashes in all; the key of table (i, j) joins band i of the left with band j of the right
collection, which makes BANDS ** 2 tables of 2 * ROWS rows. Plain banding would need BANDS ** 2 * 2 * ROWS hashes. Two
sets with similarity s meet unless a whole collection fails them: at most 2 * (1 - s ** ROWS) ** BANDS, 8e-7 at 0.8.

Keys are only made where they can matter: a pair key needs a left and a right band that other documents have too.
Equal sets are one class from the start. Each document is compared with two smallest members of its buckets, the smallest of all and
the one that it shares most buckets with; when the links found are drawn together, only members that are still in different components are compared with each other, in
blocks of bounded size from which only links that join something come out. So a large group of copies never becomes
pairs. Sketches (16 bits of each minhash) drop pairs that are far below the threshold; the rest are confirmed on the
full sets.

Nulls: a null id is left out; a null or empty text has the empty set and no links. Rows that repeat an id count
once (the largest text). Ties: the smallest id stands for a group. A very long text is a slice of its own. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import buckets_for, discard, forest, in_blocks, named_as, one_row_per_id, plain_names, shared_keys, short_keys, stored
from .text import Ranges, as_lists, mix, salted, slices, words_of

BANDS, ROWS = 28, 4
HASHES = 2 * BANDS * ROWS
#: Below this share of equal minhashes a pair isn't looked at further: more than five deviations under 0.8.
SKETCH_FLOOR = 0.65
#: Documents of a group that meet in one task.
BLOCK = 512
_PIECE = 512 << 10


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each text in ascending order, and where each text's begin (len + 1 offsets)."""
    w = words_of(texts, lower=True)
    ranges = Ranges(w.name, 3)
    start = np.arange(max(0, len(w.name) - shingle + 1))
    start = start[w.doc[start] == w.doc[start + shingle - 1]]
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < shingle))
    begin = np.concatenate([start, w.first[few]])
    name = ranges.hashes(begin, np.concatenate([start + shingle, w.first[few + 1]]))
    doc = w.doc[begin]
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    name, doc = name[fresh], doc[fresh]
    return name, np.searchsorted(doc, np.arange(w.docs + 1))


def minhashes(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each of HASHES minhashes of every set that isn't empty."""
    rng = np.random.default_rng(20)
    salts = rng.integers(0, 2**64, HASHES, np.uint64)
    factors = rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    begin = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begin), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = (np.minimum.reduceat((names ^ salts[k]) * factors[k], begin) >> np.uint64(16)).astype(np.uint16)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Keys of the left bands, then of the right ones."""
    whole = np.ascontiguousarray(sketch).view(np.uint64)  # four 16-bit minhashes are one band
    return mix(whole + np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                names, first = shingle_sets(piece.column("text"), shingle)
                count = np.diff(first)
                some = count > 0
                one, two = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64)
                sketch = [None] * len(count)
                if some.any():
                    begin = first[:-1][some]
                    one[some] = np.add.reduceat(salted(names, 1), begin).view(np.int64)
                    two[some] = np.add.reduceat(salted(names, 2), begin).view(np.int64)
                    for i, row in zip(np.flatnonzero(some), minhashes(names, first), strict=True):
                        sketch[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(one), pa.array(two), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "one", "two", "sketch"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _band_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("sketch")))
            cut = np.arange(batch.num_rows + 1) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_lists(keys.ravel(), cut, pa.int64())], ["owner", "keys"])


def _pair_lists(buckets: int):
    """Of each document the keys of the tables whose left and right band others have too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            keys = band_keys(_matrix(batch.column("sketch")))
            short = short_keys(keys.ravel(), buckets).reshape(keys.shape)
            lists, offsets = [], [0]
            cut = np.asarray(batch.column("keys").offsets)
            shared = np.asarray(batch.column("keys").values)
            for i in range(batch.num_rows):
                has = np.isin(short[i], shared[cut[i]:cut[i + 1]])
                left, right = keys[i, :BANDS][has[:BANDS]], keys[i, BANDS:][has[BANDS:]]
                lists.append(mix(left[:, None] + mix(right)[None, :] * np.uint64(3)).ravel())
                offsets.append(offsets[-1] + len(lists[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_lists(np.concatenate(lists), np.array(offsets), pa.int64())], ["owner", "keys"])
    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            left, right = _matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b"))
            near = (left == right).sum(axis=1) >= SKETCH_FLOOR * HASHES
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", _PIECE):
                names, first = shingle_sets(piece.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), as_lists(names, first, pa.int64())], ["doc_id", "names"])
    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            columns = [(np.asarray(batch.column(c).values), np.asarray(batch.column(c).offsets)) for c in ("names_a", "names_b")]
            for i in range(batch.num_rows):
                a, b = (values[cut[i]:cut[i + 1]] for values, cut in columns)
                common = len(np.intersect1d(a, b, assume_unique=True))
                held.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(held, pa.bool_())) for c in ("a", "b")], ["a", "b"])
    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each left band of a document."""
    for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
        keys = band_keys(_matrix(batch.column("sketch")))[:, :BANDS]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "n_shingles")), as_lists(keys.ravel(), np.arange(len(keys) + 1) * BANDS, pa.int64())],
                                         ["doc_id", "label", "n_shingles", "bands"])


def _apart(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of two blocks in order, and for each the labels and blocks."""
    return tuple(np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "label", "_block"))


def _may_link(i: np.ndarray, label: np.ndarray, block: np.ndarray, one_block: bool) -> np.ndarray:
    """Which later rows each of the rows ``i`` has to be compared with."""
    other = label[i, None] != label[None, :]
    return other & (np.arange(len(label))[None, :] > i[:, None] if one_block else (block[i, None] == block.min()) & (block[None, :] != block.min()))


def _links(doc: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    a, b = forest(a, b)
    return pa.table({"a": pa.array(doc[a], pa.int64()), "b": pa.array(doc[b], pa.int64())})


def _near_in_block(percent: int):
    """Links by sketches between documents of different components."""
    def run(table: pa.Table) -> pa.Table:
        doc, label, block = _apart(table)
        one_block = table.column("_lo")[0].as_py() == table.column("_hi")[0].as_py()
        if (label == label[0]).all() or not one_block and (block == block[0]).all():
            return _links(doc, [])
        sketch, n = _matrix(table.column("sketch").combine_chunks()), np.asarray(table.column("n_shingles").combine_chunks())
        pairs = []
        for at in range(0, len(doc), 32):
            i = np.arange(at, min(at + 32, len(doc)))
            may = _may_link(i, label, block, one_block)
            may &= 100 * np.minimum(n[i, None], n[None, :]) >= percent * np.maximum(n[i, None], n[None, :])
            if may.any():
                cols = np.flatnonzero(may.any(axis=0))
                near = (sketch[i, None, :] == sketch[None, cols, :]).sum(axis=2) >= SKETCH_FLOOR * HASHES
                x, y = np.nonzero(near & may[:, cols])
                pairs.append((i[x], cols[y]))
        return _links(doc, pairs)
    return run


def _linked_in_block(percent: int):
    """Links on full sets between documents of different components."""
    def run(table: pa.Table) -> pa.Table:
        doc, label, block = _apart(table)
        one_block = table.column("_lo")[0].as_py() == table.column("_hi")[0].as_py()
        if (label == label[0]).all() or not one_block and (block == block[0]).all():
            return _links(doc, [])
        lists = table.column("names").combine_chunks()
        cut = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        _, of = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        size, pairs = np.diff(cut), []
        mark = np.zeros(of.max() + 1, np.int32)
        for i in range(len(doc)):
            may = _may_link(np.array([i]), label, block, one_block)[0]
            if may.any():
                mark[of[cut[i]:cut[i + 1]]] = 1
                common = np.add.reduceat(mark[of], cut[:-1])
                mark[of[cut[i]:cut[i + 1]]] = 0
                y = np.flatnonzero(may & (100 * common >= percent * (size[i] + size - common)))
                pairs.append((np.full(len(y), i), y))
        return _links(doc, pairs)
    return run


def _sets_of(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    return stored(docs.join(needed, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, names array<long>"))


def _star_links(stars: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``stars`` whose full sets are similar enough, and the sets that were needed."""
    a, b = (classes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("a", "b"))
    near = stars.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    near = stored(near.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_close, "a long, b long"))
    needed = stored(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = _sets_of(docs, needed, shingle)
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("names").alias(f"names_{x}")) for x in ("a", "b"))
    return stored(near.join(a, "a").join(b, "b").select("a", "b", "names_a", "names_b").mapInArrow(_similar(percent), "a long, b long")), sets


def _cross_links(meet: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between members of a bucket that are in different components so far; enough of them to join those."""
    labelled = stored(meet.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("label")))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    apart = stored(labelled.join(mixed, "key", "left_semi").select("doc_id", "label").distinct())
    known = classes.join(apart, "doc_id")
    bands = known.mapInArrow(_band_rows, "doc_id long, label long, n_shingles long, bands array<long>").select(
        "doc_id", "label", "n_shingles", F.explode("bands").alias("band"))
    crowded = bands.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    rows = bands.join(crowded, "band", "left_semi").join(classes.select("doc_id", "sketch"), "doc_id")
    near = in_blocks(rows, "band", "doc_id", BLOCK).groupBy("band", "_lo", "_hi").applyInArrow(_near_in_block(percent), "a long, b long")
    groups = components(near)
    if groups.isEmpty():
        return groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    members = stored(groups.withColumnsRenamed({"node": "doc_id", "component": "band"}).join(apart, "doc_id"))
    more = _sets_of(docs, stored(members.select("doc_id").join(sets, "doc_id", "left_anti")), shingle)
    rows = members.join(sets.unionByName(more), "doc_id")
    return stored(in_blocks(rows, "band", "doc_id", BLOCK).groupBy("band", "_lo", "_hi").applyInArrow(_linked_in_block(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    id that links lead to, kept says whether that is the document's own.
    """
    docs = one_row_per_id(docs, "doc_id", "text")
    sketched = stored(docs.mapInArrow(_sketches(shingle), "doc_id long, n_shingles long, one long, two long, sketch binary"))
    least = stored(sketched.where("n_shingles > 0").groupBy("n_shingles", "one", "two").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    members = stored(sketched.select("doc_id", "n_shingles", "one", "two").join(least, ["n_shingles", "one", "two"], "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")))
    alone = members.where("doc_id = class_id and n_shingles > 0").select("doc_id")
    classes = stored(sketched.select("doc_id", "n_shingles", "sketch").join(alone, "doc_id", "left_semi"))

    number = classes.count()
    buckets = buckets_for(docs, number * 2.0 * BANDS)
    bands = shared_keys(classes.mapInArrow(_band_lists, "owner long, keys array<long>"), buckets)
    pairing = classes.join(bands.withColumnRenamed("owner", "doc_id"), "doc_id")
    meet = shared_keys(pairing.mapInArrow(_pair_lists(buckets), "owner long, keys array<long>"), buckets)
    meet = stored(meet.select(F.col("owner").alias("doc_id"), F.explode("keys").alias("key")))

    centre = meet.groupBy("key").agg(F.min("doc_id").alias("a"))
    near = meet.join(centre, "key").where("a < doc_id").groupBy("a", "doc_id").count().groupBy("doc_id").agg(
        F.max(F.struct("count", (-F.col("a")).alias("a"))).alias("most"), F.min("a").alias("least"))
    stars = stored(near.select(F.explode(F.array_distinct(F.array(-F.col("most.a"), "least"))).alias("a"), F.col("doc_id").alias("b")))
    links, sets = _star_links(stars, classes, docs, shingle, percent)
    labels = components(links)
    more = _cross_links(meet, labels, classes, sets, docs, shingle, percent)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    discard(sketched, least, classes, meet, stars, sets, links)  # what is returned reads members and labels
    return members.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "class_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id. A null id stays."""
    plain = plain_names(docs, "doc_id", "text")
    gone = near_duplicates(plain, shingle, percent).where("not kept").select("doc_id")
    return named_as(plain.join(gone, "doc_id", "left_anti").select(*plain.columns), docs)
