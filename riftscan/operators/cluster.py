"""Nearest-neighbour affinity graphs and their connected components.

The unit of work is a position chunk of one contig and type bucket. A chunk never holds more than
``max_group_size`` signatures, so the neighbour search, the graph and its components live in one bounded
numpy step per chunk. Spark shuffles rows by chunk and sorts them; a task walks its chunks in order and
keeps one chunk in memory at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import interval as iv
from ..functions import svtype as sv
from ..presets import GraphParams
from .features import with_guess
from .prefix import gap_sessions

PART_KEYS = ["contig", "bucket", "sess", "chunk"]
#: What calls need to know of a signature; anything else need not travel through the chunk step.
CALL_COLUMNS = [*PART_KEYS, "sid", "tstart", "tend", "svtype", "svlen", "qname", "mapq", "source", "support", "sa_contigs"]
#: Digits cosines and weights are rounded to, so that thresholds and ties do not hang on summation order.
DIGITS = 9
#: Elements of the similarity matrix that exist at a time, and rows at most.
_CELLS, _ROW_BLOCK = 1 << 19, 512
#: Columns whose largest score stands for them in the first look at a row.
_SPAN = 16


def with_bucket(df: DataFrame, include_tra: bool = False) -> DataFrame:
    """Add ``bucket`` and drop the rows that are not clustered."""
    if "guess" not in df.columns:
        df = with_guess(df)
    return df.withColumn("bucket", sv.type_bucket(F.col("svtype"), F.col("guess"), include_tra)).where(
        F.col("bucket").isNotNull())


def partition_by_position(df: DataFrame, params: GraphParams) -> DataFrame:
    """Add ``sess`` and ``chunk`` per (contig, bucket).

    Best done on bare signatures, before vectors are added: this shuffles whole rows once.
    """
    return gap_sessions(df, ["contig", "bucket"], "tstart", "sid", params.max_position_gap, params.max_group_size)


def chunk_stream(df: DataFrame, keys: list[str], order: list[str], schema: T.StructType,
                 work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Apply ``work`` to every group of ``keys``, sorted by ``order``, one group in memory at a time.

    Meant for groups with a proven size bound. Small groups share Arrow batches, so a million tiny
    groups do not cost a million Python calls into Spark.
    """
    sorted_rows = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            results = [out for out in map(work, groups) if out.num_rows]
            if results:
                yield from pa.concat_tables(results).combine_chunks().to_batches()

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            if table.num_rows == 0:
                continue
            table = table.combine_chunks()
            cuts = _group_starts(table, keys)
            yield from emit([table.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])])
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from emit([held.combine_chunks()])

    return sorted_rows.mapInArrow(run, schema)


def _group_starts(table: pa.Table, keys: list[str]) -> list[int]:
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        values = table.column(key).to_pandas().to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed).tolist()


def unit_vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as float64 vectors of length one."""
    lists = column.combine_chunks()
    matrix = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(lists), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.maximum(norms, 1e-12)


def _row_blocks(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Cuts of ``n`` rows whose scores against ``width`` columns stay within bounds."""
    step = max(1, min(_ROW_BLOCK, _CELLS // max(1, width)))
    for low in range(0, n, step):
        yield low, min(n, low + step)


def _largest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of the k largest positive scores of every row; ties go to the earlier column.

    Each span of columns is looked at by its largest score first: the k-th largest of those is no larger than the k-th
    largest score, so what lies below it by more than a rounding step is out. Only the few others are rounded and sorted.
    """
    n, wide = scores.shape[1], scores.shape[1] // _SPAN
    low = np.full(len(scores), -np.inf)
    if wide >= k:
        tops = scores[:, :wide * _SPAN].reshape(-1, _SPAN, wide).max(axis=1)
        low = np.partition(tops, wide - k, axis=1)[:, wide - k]
    step = 10.0 ** -DIGITS
    at = np.flatnonzero((scores >= np.maximum(low - 1.1 * step, 0.4 * step)[:, None]).ravel())
    rows, values = at // n, np.round(scores.ravel()[at], DIGITS)
    if len(at) > 2 * k * len(scores):
        # Copies of one vector: where the best score comes k times, the first k are the winners.
        starts = np.searchsorted(rows, np.arange(len(scores) + 1))
        some = np.flatnonzero(np.diff(starts))
        best = np.full(len(scores), -np.inf)
        best[some] = np.maximum.reduceat(values, starts[some])
        top = values == best[rows]
        before = np.concatenate(([0], np.cumsum(top)))
        full = (before[starts[1:]] - before[starts[:-1]] >= k)[rows]
        keep = np.flatnonzero(~full | top & (before[:-1] - before[starts[rows]] < k))
        at, rows, values = at[keep], rows[keep], values[keep]
    cols = at - rows * n
    order = np.lexsort((cols, -values, rows))
    order = order[values[order] > 0]
    rows, cols, values = rows[order], cols[order], values[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], values[keep]


def _without_gaps(vectors: np.ndarray, k: int) -> tuple[np.ndarray, bool]:
    """Vectors with zeros for those that hold no number, which then are near to nothing, and whether k others are left."""
    broken = np.isnan(vectors).any(axis=1)
    return (np.where(broken[:, None], 0.0, vectors) if broken.any() else vectors), len(vectors) - broken.sum() >= k


def _distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of every distinct vector, in row order, and the number of each row's vector in that list."""
    whole = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, first, which = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[which]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as its size, one range after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _nearest_with_copies(kinds: np.ndarray, which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest other rows where many rows have equal vectors: ``kinds`` meet, and the first rows of the k + 1 nearest are ranked.

    Kinds are in the order of their first rows, so among equal scores the k + 1 first kinds hold the k + 1 first rows.
    """
    nearest = [tuple(x + low * (i == 0) for i, x in enumerate(_largest(kinds[low:high] @ kinds.T, min(k + 1, len(kinds)))))
               for low, high in _row_blocks(len(kinds), len(kinds))]
    kind, other, value = (np.concatenate(p) for p in zip(*nearest))
    members = np.argsort(which, kind="stable")
    sizes = np.bincount(which, minlength=len(kinds))
    starts = np.cumsum(sizes) - sizes
    some = np.minimum(sizes[other], k + 1)
    kind, value, col = np.repeat(kind, some), np.repeat(value, some), members[_ranges(starts[other], some)]
    order = np.lexsort((col, -value, kind))
    order = order[np.arange(len(order)) - np.searchsorted(kind[order], kind[order], side="left") <= k]
    kind, value, col = kind[order], value[order], col[order]
    # Every row takes the list of its kind, without itself.
    lengths = np.bincount(kind, minlength=len(kinds))
    own = lengths[which]
    at = _ranges((np.cumsum(lengths) - lengths)[which], own)
    rows = np.repeat(np.arange(len(which)), own)
    others = col[at] != rows
    rows, at = rows[others], at[others]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], col[at[keep]], value[at[keep]]


def nearest_neighbours(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed edges (row, column, cosine) to the k most similar other rows.

    Ties go to the earlier row; similarities of zero or less are no edges.
    """
    n = len(vectors)
    k = max(1, min(int(k), n - 1))
    vectors, enough = _without_gaps(vectors, k)
    if enough and n > 1:
        first, which = _distinct(vectors)
        if 2 * len(first) <= n:
            return _nearest_with_copies(vectors[first], which, k)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low, high in _row_blocks(n if enough else 0, n):
        scores = vectors[low:high] @ vectors.T
        scores[np.arange(high - low), np.arange(low, high)] = -np.inf
        rows, cols, values = _largest(scores, k)
        parts.append((rows + low, cols, values))
    rows, cols, values = (np.concatenate(p) for p in zip(*parts))
    return rows, cols, values


def _nearest_in_blocks(ident: str, vector: str, k: int):
    """The k nearest rows of the other block for every row of two blocks, or of its own block where a block meets itself."""
    def work(met: pa.Table) -> pa.Table:
        ids, own, low, high = (np.asarray(met.column(c).combine_chunks()) for c in (ident, "own", "lo", "hi"))
        order = np.argsort(ids, kind="stable")
        ids, own, vectors = ids[order], own[order], unit_vectors(met.column(vector))[order]
        sides = [np.flatnonzero(own == block) for block in (low[0], high[0])]
        ways = [(sides[0], sides[1]), (sides[1], sides[0])][:1 if low[0] == high[0] else 2]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for rows_of, cols_of in ways:
            dst = ids[cols_of]
            nearest = min(k, len(dst))
            columns, enough = _without_gaps(vectors[cols_of], nearest)
            for at, end in _row_blocks(len(rows_of) if len(dst) and enough else 0, len(dst)):
                src = ids[rows_of[at:end]]
                block = vectors[rows_of[at:end]]
                scores = np.where(np.isnan(block).any(axis=1)[:, None], 0.0, block) @ columns.T
                # The same id is no neighbour; ids are sorted.
                first, last = (np.searchsorted(dst, src, side) for side in ("left", "right"))
                for i in np.flatnonzero(last > first):
                    scores[i, first[i]:last[i]] = -np.inf
                rows, cols, values = _largest(scores, nearest)
                out.append((src[rows], dst[cols], values))
        s, t, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"src": pa.array(s, pa.int64()), "dst": pa.array(t, pa.int64()), "cosine": pa.array(c, pa.float64())})
    return work


def knn_within(df: DataFrame, group: str, ident: str, vector: str, k: int, symmetric: bool = False, block_rows: int = 16384) -> DataFrame:
    """Exact k nearest rows (src, dst, cosine) of every row among all rows of its group; similarities of zero or less are no edges.

    The answer is exact, so the work is quadratic in the size of a group; clustering, whose groups are chunks of bounded
    size, doesn't come here. Groups are cut into blocks by a hash of the id, and every two blocks of a group meet once,
    for both directions: a row is sent once for each block of its group, a task holds two blocks, and the winners of the
    meetings are ranked per row. Ties go to the smaller id. Rows without a vector or group have no edges. ``symmetric``
    gives both directions the larger weight.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), ident, vector)
    sizes = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    blocked = rows.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64(ident), F.col("blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", ident, vector)
    met = dealt.groupBy("grp", "lo", "hi").applyInArrow(_nearest_in_blocks(ident, vector, k), "src long, dst long, cosine double")
    best = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    edges = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    if not symmetric:
        return edges
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cosine")).groupBy("src", "dst").agg(F.max("cosine").alias("cosine"))


def symmetric_edges(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int):
    """Undirected edges (a < b) with the larger weight of the two directions."""
    a, b = np.minimum(rows, cols), np.maximum(rows, cols)
    code = a * np.int64(n) + b
    unique, inverse = np.unique(code, return_inverse=True)
    weight = np.full(len(unique), -np.inf)
    np.maximum.at(weight, inverse, values)
    return unique // n, unique % n, weight


def component_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of every node's component: hooking and pointer jumping on arrays."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def _edge_weights(table: pa.Table, params: GraphParams):
    """Weighted undirected edges of one chunk: cosine x position x length x source."""
    n = table.num_rows
    if n < 2:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0), np.zeros(0)
    a, b, cosine = symmetric_edges(*nearest_neighbours(unit_vectors(table.column("emb")), params.k_neighbors), n)
    center = table.column("center").to_numpy().astype(np.float64)
    length = np.maximum(1, table.column("sim_len").to_numpy()).astype(np.float64)
    gap = np.abs(center[a] - center[b])
    near = gap <= params.max_position_gap
    a, b, cosine, gap = a[near], b[near], cosine[near], gap[near]
    position = np.maximum(0.10, 1.0 - gap / max(1.0, float(params.max_position_gap)))
    size = np.maximum(0.20, np.sqrt(np.minimum(length[a], length[b]) / np.maximum(length[a], length[b])))
    sources, code = np.unique(np.asarray(table.column("source").to_pandas().fillna("")), return_inverse=True)
    tokens = [frozenset(t for t in s.split("|") if t) for s in sources]
    pairs, which = np.unique(code[a] * np.int64(len(sources)) + code[b], return_inverse=True)
    bonus = np.array([1.10 if tokens[p // len(sources)] & tokens[p % len(sources)] else 1.0 for p in pairs.tolist()])
    return a, b, cosine, cosine * position * size * (bonus[which] if len(pairs) else 1.0)


def _ready(df: DataFrame, params: GraphParams, include_tra: bool) -> DataFrame:
    """Partitioned signatures with the columns the chunk step reads; already partitioned ones stay as they are."""
    parted = df if "chunk" in df.columns else partition_by_position(with_bucket(df, include_tra), params)
    sim_len = F.when(F.col("bucket") == "INS", F.abs(F.coalesce("svlen", F.lit(0)))).otherwise(
        iv.length_estimate(F.col("svlen"), F.col("tstart"), F.col("tend")))
    return parted.withColumn("center", iv.center(F.col("tstart"), F.col("tend"))).withColumn("sim_len", sim_len)


_KEY_FIELDS = [
    T.StructField("contig", T.StringType()), T.StructField("bucket", T.StringType()),
    T.StructField("sess", T.LongType()), T.StructField("chunk", T.LongType()),
]


def affinity_edges(df: DataFrame, params: GraphParams, include_tra: bool = False) -> DataFrame:
    """Undirected weighted edges (src < dst in chunk order) of every chunk, before the threshold."""
    ready = _ready(df, params, include_tra).select(*PART_KEYS, "tstart", "sid", "center", "sim_len", "source", "emb")
    schema = T.StructType([*_KEY_FIELDS, T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                           T.StructField("cosine", T.DoubleType()), T.StructField("weight", T.DoubleType())])

    def work(table: pa.Table) -> pa.Table:
        a, b, cosine, weight = _edge_weights(table, params)
        sid = table.column("sid").to_numpy()
        keys = [pa.array(np.repeat(table.column(k)[0].as_py(), len(a))) if len(a) else
                pa.array([], type=table.schema.field(k).type) for k in PART_KEYS]
        low, high = np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])
        return pa.table([*(k.cast(table.schema.field(n).type) for k, n in zip(keys, PART_KEYS)),
                         pa.array(low), pa.array(high), pa.array(cosine), pa.array(np.round(weight, DIGITS))],
                        names=[f.name for f in schema.fields])

    return chunk_stream(_typed_keys(ready), PART_KEYS, ["sid"], schema, work)


def _typed_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("sess", F.col("sess").cast("bigint")).withColumn("chunk", F.col("chunk").cast("bigint"))


def clusters(df: DataFrame, params: GraphParams, include_tra: bool = False) -> DataFrame:
    """Members of all clusters: the input columns plus ``cluster_id`` (its smallest sid) and ``n_members``.

    ``emb`` comes back with length one. Input columns travel through the chunk step, so nothing needs to
    be joined back afterwards.
    """
    ready = _typed_keys(_ready(df, params, include_tra))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in ready.schema.fields if f.name != "emb"],
                           T.StructField("emb", T.ArrayType(T.DoubleType())),
                           T.StructField("cluster_id", T.LongType()), T.StructField("n_members", T.IntegerType())])
    names = [f.name for f in schema.fields]

    def work(table: pa.Table) -> pa.Table:
        n = table.num_rows
        a, b, _, weight = _edge_weights(table, params)
        kept = np.round(weight, DIGITS) >= params.similarity_threshold
        label = component_labels(n, a[kept], b[kept])
        size = np.bincount(label, minlength=n)[label]
        chosen = np.flatnonzero(size >= params.min_cluster_size)
        sid = table.column("sid").to_numpy()
        lowest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(lowest, label, sid)
        unit = unit_vectors(table.column("emb"))[chosen]
        offsets = pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * unit.shape[1])
        emb = pa.ListArray.from_arrays(offsets, pa.array(unit.reshape(-1)))
        out = table.drop_columns(["emb"]).take(pa.array(chosen))
        return (out.append_column("emb", emb)
                .append_column("cluster_id", pa.array(lowest[label][chosen]))
                .append_column("n_members", pa.array(size[chosen].astype(np.int32))).select(names))

    return chunk_stream(ready, PART_KEYS, ["sid"], schema, work)
