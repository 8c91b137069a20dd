"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of about SHARD_ROWS by a hash of their id; vectors of one direction are one node, and equal
vectors one member of it that remembers the smallest ids (as many as an answer can need). A shard's graph is grown in
batches: a greedy beam search on the graph so far proposes neighbours, and pruning keeps the nearest one, drops those
that are ALPHA times nearer to it than to the node itself, and goes on with the rest, up to DEGREE edges; free places
go to the nearest of the dropped. Edges also go back, pruned the same way. A search starts from the best of ENTRIES nodes,
so groups that the graph hardly connects are reached, and computes no distance twice. Every query beam-searches every
shard, in blocks of queries; the whole beam is scored exactly and widened while its last node ties with the last answer.
Each shard's best meet in one ranking per query.

Nearness is the cosine in double precision on the original vectors; the graphs themselves use single precision.
A vector that is null, empty, zero or holds a null or non-finite component takes no part, neither as query nor as
candidate; vectors of different lengths don't meet. A null id is left out; rows that repeat an id count once (the
largest vector). Fewer candidates than asked for are all returned; ties go to the smaller id. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lattice_dedup import usable
from .tables import one_row_per_id, stored

SHARD_ROWS, QUERY_ROWS, NODE_MEMBERS = 32_768, 16_384, 1024
DEGREE, BEAM, SEARCH_BEAM, ALPHA = 24, 48, 96, 1.2
#: Nodes of which a search tries all; it starts from the nearest.
ENTRIES = 256
_EXPAND, _BATCH, _PRUNED = 4, 256, 72


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors; endless where an id is missing."""
    return np.where(ids >= 0, 2 - 2 * np.einsum("bkd,bd->bk", x[ids], q), np.float32(np.inf))


@dataclass
class Found:
    """Nodes by row of the queries, nearest first (-1: none), their squared distances, and how many were computed."""

    ids: np.ndarray
    far: np.ndarray
    computed: int


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, visited: bool = False) -> Found:
    """The nodes nearest to each row of ``q``, or all expanded ones. No distance is computed twice for a query."""
    rows = len(q)
    seen = np.zeros((rows, len(x)), bool)
    seen[:, entries] = True
    start = 2 - 2 * (q @ x[entries].T)
    computed = start.size
    first = np.argsort(start, axis=1, kind="stable")[:, :beam]
    ids = np.full((rows, beam), -1, np.int32)
    far = np.full((rows, beam), np.float32(np.inf))
    ids[:, :first.shape[1]] = entries[first]
    far[:, :first.shape[1]] = np.take_along_axis(start, first, 1)
    done = ids < 0
    seen_ids, seen_far = [], []
    active = np.arange(rows)
    while len(active):
        open_ = ~done[active]
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :_EXPAND]
        line = np.arange(len(active))[:, None]
        real = open_[line, pick]
        chosen = np.where(real, ids[active[:, None], pick], -1)
        done[active[:, None], pick] = True
        if visited:
            for out, value, none in ((seen_ids, chosen, -1), (seen_far, np.where(real, far[active[:, None], pick], np.inf), np.inf)):
                block = np.full((rows, _EXPAND), none, value.dtype)
                block[active] = value
                out.append(block)
        new = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(active), -1)
        new = np.sort(np.where((new >= 0) & seen[active[:, None], new], -1, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        r, c = np.nonzero(new >= 0)
        node = new[r, c]
        seen[active[r], node] = True
        computed += len(node)
        new_far = np.full(new.shape, np.float32(np.inf))
        new_far[r, c] = 2 - 2 * np.einsum("nd,nd->n", x[node], q[active[r]])
        all_ids = np.concatenate([ids[active], new], axis=1)
        all_far = np.concatenate([far[active], new_far], axis=1)
        all_done = np.concatenate([done[active], new < 0], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        ids[active], far[active], done[active] = all_ids[line, best], all_far[line, best], all_done[line, best]
        active = active[~done[active].all(axis=1)]
    if visited:
        return Found(np.concatenate(seen_ids, axis=1), np.concatenate(seen_far, axis=1), computed)
    return Found(ids, far, computed)


def robust_prune(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
    """DEGREE neighbours of each node among candidates ``ids`` at squared distances ``far``.

    The nearest is kept and drops those that are ALPHA times nearer to it than to the node, and so on; places that this
    leaves free go to the nearest of the dropped, so that a tight group stays in one piece.
    """
    line = np.arange(len(nodes))[:, None]
    far = np.where((ids < 0) | (ids == nodes[:, None]), np.float32(np.inf), far)
    order = np.argsort(ids, axis=1, kind="stable")
    again = np.zeros(order.shape, bool)
    again[:, 1:] = ids[line, order][:, 1:] == ids[line, order][:, :-1]
    far[line, order] = np.where(again, np.float32(np.inf), far[line, order])
    best = np.argsort(far, axis=1, kind="stable")[:, :_PRUNED]
    ids, far = ids[line, best], far[line, best]
    between = 2 - 2 * np.matmul(x[ids], x[ids].transpose(0, 2, 1))
    live, kept = np.isfinite(far), np.zeros(far.shape, bool)
    rows = np.arange(len(nodes))
    for _ in range(DEGREE):
        first = live.argmax(axis=1)
        some = live[rows, first]
        if not some.any():
            break
        kept[rows[some], first[some]] = True
        live &= ~(ALPHA ** 2 * between[rows, first] <= far)
        live[rows, first] = False
    place = np.argsort(np.where(kept, 0, np.where(np.isfinite(far), 1, 2)), axis=1, kind="stable")[:, :DEGREE]
    out = np.full((len(nodes), DEGREE), -1, np.int32)
    out[:, :place.shape[1]] = np.where(np.isfinite(far[line, place]), ids[line, place], -1)
    return out


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges (-1: none) of every row of unit vectors ``x``, and the nodes where searches may start."""
    n = len(x)
    edges = np.full((n, DEGREE), -1, np.int32)
    order = np.random.default_rng(7).permutation(n)
    entries = order[:ENTRIES].astype(np.int32)
    for again in (False, True):  # the second round sees the whole graph
        at = 0 if again else 1
        while at < n:
            batch = order[at:at + (_BATCH if again else min(_BATCH, max(1, at // 2)))]
            start = entries[:at] if not again else entries
            at += len(batch)
            found = beam_search(x, edges, start, x[batch], BEAM, visited=True)
            old = edges[batch]
            edges[batch] = robust_prune(x, batch, np.concatenate([found.ids, old], axis=1), np.concatenate([found.far, _distances(x, old, x[batch])], axis=1))
            source, target = np.repeat(batch, DEGREE), edges[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(nodes), int(count.max()) if len(nodes) else 0), -1, np.int32)
            back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            for part in np.array_split(np.arange(len(nodes)), max(1, len(nodes) // 1024)):
                ids = np.concatenate([edges[nodes[part]], back[part]], axis=1)
                edges[nodes[part]] = robust_prune(x, nodes[part], ids, _distances(x, ids, x[nodes[part]]))
    return edges, entries


def _unit(lists: pa.ListArray) -> np.ndarray:
    """Rows at length one, in double precision."""
    x = np.asarray(lists.flatten()).reshape(len(lists), -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(table: pa.Table) -> pa.Table:
    edges, entries = build_graph(_unit(table.column("embedding").combine_chunks()).astype(np.float32))
    cut = pa.array((np.arange(len(edges) + 1) * DEGREE).astype(np.int32))
    entry = np.full(len(edges), -1)
    entry[entries] = np.arange(len(entries))
    return table.append_column("node", pa.array(np.arange(len(edges)))).append_column(
        "edges", pa.ListArray.from_arrays(cut, pa.array(edges.ravel()))).append_column("entry", pa.array(entry))


class Shard:
    """A shard's graph and the vectors of its nodes' members."""

    def __init__(self, index: pa.Table) -> None:
        index = index.take(pa.array(np.argsort(np.asarray(index.column("node").combine_chunks()))))
        self.x = _unit(index.column("embedding").combine_chunks()).astype(np.float32)
        self.edges = np.asarray(index.column("edges").combine_chunks().flatten()).reshape(len(self.x), DEGREE)
        entry = np.asarray(index.column("entry").combine_chunks())
        self.entries = np.flatnonzero(entry >= 0)[np.argsort(entry[entry >= 0])].astype(np.int32)
        members = index.column("members").combine_chunks()
        self.first = np.asarray(members.offsets) - members.offsets[0].as_py()
        self.exact = _unit(members.flatten().field("embedding"))
        self.ids = members.flatten().field("ids").to_pylist()

    def best(self, ident: int, q: np.ndarray, nodes: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(-score, id) of the k nearest vectors among the nodes' members."""
        at = np.concatenate([np.arange(self.first[n], self.first[n + 1]) for n in nodes]) if len(nodes) else np.zeros(0, int)
        score = (self.exact[at] * q).sum(axis=1)
        if len(score) > k + 1:
            keep = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            at, score = at[keep], score[keep]
        return sorted((-s, v) for m, s in zip(at.tolist(), score.tolist(), strict=True) for v in self.ids[m] if v != ident)[:k]

    def nearest(self, idents: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """The whole beam is scored; where its last node is as near as the last answer, a wider one, in the end all nodes."""
        out: list = [[]] * len(q)
        todo, beam = np.arange(len(q)), SEARCH_BEAM
        while len(todo):
            if beam > SEARCH_BEAM and 4 * beam > len(self.x):
                for i in todo.tolist():
                    out[i] = self.best(int(idents[i]), q[i], np.arange(len(self.x)), k)
                break
            found = beam_search(self.x, self.edges, self.entries, q[todo].astype(np.float32), beam)
            wider = []
            for i, nodes, far in zip(todo.tolist(), found.ids, found.far, strict=True):
                out[i] = self.best(int(idents[i]), q[i], nodes[nodes >= 0], k)
                if nodes[-1] >= 0 and len(self.x) > beam and (len(out[i]) < k or -out[i][-1][0] <= 1 - far[-1] / 2 + 1e-6):
                    wider.append(i)
            todo, beam = np.array(wider, int), beam * 4
        return out


def _search(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if index.num_rows and queries.num_rows:
            shard = Shard(index)
            q, ident = _unit(queries.column("embedding").combine_chunks()), np.asarray(queries.column("query_id").combine_chunks())
            for at in range(0, len(q), _BATCH):
                part = ident[at:at + _BATCH]
                for me, each in zip(part.tolist(), shard.nearest(part, q[at:at + _BATCH], k), strict=True):
                    found += [(me, v, -s) for s, v in each]
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})
    return run


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not once for each element that a lambda visits."""
    return F.transform(F.array(value), use)[0]


def _direction(vector: Column) -> Column:
    """A vector's components at length one, to six places: multiples of one vector have one direction."""
    def unit(x: Column) -> Column:
        length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
        return _once(length, lambda n: F.transform(x, lambda v: F.round(v / n, 6) + F.lit(0.0)))

    top = F.array_max(F.transform(vector, lambda v: F.abs(v.cast("double"))))
    return _once(_once(top, lambda t: F.transform(vector, lambda v: v.cast("double") / t)), unit)


def build_index(vectors: DataFrame, k: int = 5) -> DataFrame:
    """size, shard, ids and vectors of members, node, embedding, edges, entry: one row for each distinct direction.

    A member is a distinct vector with its smallest ids; a direction with more than NODE_MEMBERS of them is several nodes.
    """
    rows = one_row_per_id(vectors, "vec_id", "embedding").where(usable(F.col("embedding")))
    same = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("_rank", F.row_number().over(same)).where(F.col("_rank") <= k + 1)  # an answer needs no more of equal vectors
    distinct = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    alike = distinct.withColumn("_way", _direction(F.col("embedding"))).withColumn(
        "_part", F.floor((F.row_number().over(Window.partitionBy("_way").orderBy(F.col("ids")[0])) - 1) / NODE_MEMBERS))
    nodes = stored(alike.groupBy("_way", "_part").agg(F.sort_array(F.collect_list(F.struct("ids", "embedding"))).alias("members")).select(
        "members", F.col("members")[0]["embedding"].alias("embedding"), F.size("_way").alias("size")))
    counts = nodes.groupBy("size").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("_shards"))
    # Shards are few bytes and much work: without a number of their own, partitions would be merged into one task.
    tasks = 4 * int(counts.agg(F.sum("_shards")).first()[0] or 1)
    nodes = nodes.join(counts, "size").withColumn("shard", F.pmod(F.xxhash64(F.col("members")[0]["ids"][0]), F.col("_shards")))
    dealt = nodes.select("size", "shard", "members", "embedding").repartition(tasks, "size", "shard")
    kind = dict(vectors.dtypes)["embedding"]
    return stored(dealt.groupBy("size", "shard").applyInArrow(
        _index, f"size int, shard long, members array<struct<ids: array<bigint>, embedding: {kind}>>, embedding {kind}, node long, edges array<int>, entry long"))


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest nodes found for each row of ``queries`` (vec_id, embedding), itself apart.

    A query goes to every shard; a shard's graph is sent once for each block of QUERY_ROWS queries.
    """
    asked = one_row_per_id(queries, "vec_id", "embedding").where(usable(F.col("embedding"))).select(
        F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("size"))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    shards = index.groupBy(F.col("size").alias("of_size")).agg(F.collect_set("shard").alias("in_shards"))
    asked = asked.withColumn("in_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).join(shards, F.col("size") == F.col("of_size"))
    asked = asked.withColumn("in_shard", F.explode("in_shards")).drop("in_shards")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    found = index.select("*", every).groupBy("size", "shard", "block").cogroup(asked.groupBy("of_size", "in_shard", "in_block")).applyInArrow(
        _search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """The k nearest of every row that fulfils ``query``, among all rows."""
    return search(build_index(vectors, k), vectors.where(query), k)
