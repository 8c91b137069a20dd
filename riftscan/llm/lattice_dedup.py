"""Near duplicates of embeddings by lattice hashing.

Each table projects unit vectors onto random directions, eight for each code, and decodes every eight values to the nearest
point of the lattice E8: the points together are the vector's own cell. It also looks into the PROBES cells next to it whose
centres come nearest. Two vectors of a label meet in a table if one's own cell is the other's own or probed one. How likely a
pair at the threshold meets depends on nothing but its cosine, so it is simulated, and there are as many tables as leave one
such pair in a million (MISSED) apart; nearer pairs practically always meet. Cells get narrower with the rows of the largest
label: more codes and tables mean more rows for each vector, but far fewer strangers in its cells (see PLANS).

Vectors meet as bytes (eight bits a component), which drops pairs that are clearly too far apart: a vector carries how far
its bytes are from it, which bounds how much any cosine can lose, so no pair at the threshold is dropped. The others are
confirmed by the cosine of the original vectors in double precision.

Equal vectors of a label are one class, met once and counted by its size. A crowded cell is cut into blocks, and
blocks meet in pairs, so no task sees an unbounded cell. A pair is left to the first table whose own cells agree.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do those without a
label; vectors of different lengths neither. A null id is left out, rows that repeat an id count once (the largest
label and vector). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cuts, one_row_per_id, partitions, stored
from .text import mix, once, salted

PROBES = 8
#: Part of the pairs at the threshold that may never meet.
MISSED = 2e-6
#: (codes, length of projected vectors, rows of the largest label from which on it pays): at cosine 0.93 they take 8, 17, 27, 46
#: and 92 tables, and a vector meets 2.6e-2, 6e-3, 6e-4, 1e-4 and 2e-6 of unrelated ones. A row costs about 150 comparisons.
PLANS = ((1, 2.0, 0), (2, 1.4, 500_000), (2, 1.7, 2_500_000), (3, 1.4, 50_000_000), (3, 1.7, 500_000_000))
#: Members of a cell's block.
BLOCK = 1024
#: Rows of cells that one task call sees, on average.
BUCKET_ROWS = 40_000


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or eight halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        if bin(signs).count("1") % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


_NEAR = minimal_vectors()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole entries of even sum: round, and if the sum is odd, round the least certain entry the other way."""
    whole = np.rint(x)
    off = x - whole
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    turn = np.where(off[rows, worst] >= 0, 1.0, -1.0) * (whole.sum(axis=1) % 2 != 0)
    whole[rows, worst] += turn
    return whole


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: whole entries of even sum, or such a point moved by halves."""
    whole, half = _even_integers(x), _even_integers(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


@dataclass(frozen=True)
class Plan:
    """Tables, codes of a cell's name, and the length of projected vectors."""

    tables: int
    codes: int
    scale: float


def plan_for(rows: int, threshold: float) -> Plan:
    """The narrowest cells that pay for a label of so many rows, and the tables that they need at this threshold."""
    codes, scale, _ = next(p for p in reversed(PLANS) if rows >= p[2])
    apart = 1 - meeting_probability(codes, scale, threshold)
    return Plan(max(1, round(np.log(MISSED) / np.log(max(apart, 1e-9)))), codes, scale)


def meeting_probability(codes: int, scale: float, cosine: float, pairs: int = 20_000) -> float:
    """How likely two vectors of this cosine meet in a table: projections of unit vectors are normal, whatever their length."""
    rng = np.random.default_rng(pairs)
    x, z = rng.normal(size=(2, pairs, codes * 8)) * scale / np.sqrt(8)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * z
    none = np.zeros(pairs, np.int64)
    (own_x, probed_x), (own_y, probed_y) = _table_cells(x, 0, none), _table_cells(y, 0, none)
    met = (own_x == own_y) | (probed_x == own_y[:, None]).any(axis=1) | (probed_y == own_x[:, None]).any(axis=1)
    return float(met.mean())


def _projections(size: int, plan: Plan) -> np.ndarray:
    return once(("projections", size, plan), lambda: np.random.default_rng(size).normal(
        size=(plan.tables, size, 8 * plan.codes)) / np.sqrt(8) * plan.scale)


def _table_cells(y: np.ndarray, table: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of own and probed cells: a label's and table's salt, and a sum over the codes of each one's hashed point."""
    salt = salted(label.astype(np.int64).view(np.uint64), 100 + table)
    parts = y.reshape(len(y), -1, 8)
    point = nearest_point(parts.reshape(-1, 8)).reshape(parts.shape)
    gain = ((parts - point) @ _NEAR.T).reshape(len(y), -1)
    best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
    code, move = best // len(_NEAR), best % len(_NEAR)
    named = _point_names(point, np.arange(parts.shape[1]))
    whole = named.sum(axis=1, dtype=np.uint64)
    row = np.arange(len(y))[:, None]
    moved = _point_names(point[row, code] + _NEAR[move], code)
    return mix(salt + whole), mix(salt[:, None] + whole[:, None] - named[row, code] + moved)


def _point_names(points: np.ndarray, code: np.ndarray) -> np.ndarray:
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    name = mix((code + 1).astype(np.uint64))
    for k in range(8):
        name = mix(name * np.uint64(3) + whole[..., k])
    return name


def cells(unit: np.ndarray, label: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(own cells by table, probed cells by table and rank)."""
    own, probed = np.empty((len(unit), plan.tables), np.uint64), np.empty((len(unit), plan.tables, PROBES), np.uint64)
    for t, projection in enumerate(_projections(unit.shape[1], plan)):
        own[:, t], probed[:, t] = _table_cells(unit @ projection, t, label)
    return own, probed


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column (of one length) at length one, in double precision."""
    x = np.asarray(column.flatten()).reshape(len(column), -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def same_length(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose lists are equally long, of a few thousand rows."""
    length = np.diff(np.asarray(batch.column(column).offsets))
    for n in np.unique(length):
        part = batch.take(pa.array(np.flatnonzero(length == n)))
        for at in range(0, part.num_rows, 2000):
            yield part.slice(at, 2000)


def _members(plan: Plan):
    """A row for each vector and cell it has or probes: its bytes, how far they are from it, and short names of its own cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in same_length(whole, "embedding")):
            unit = unit_rows(batch.column("embedding"))
            own, probed = cells(unit, np.asarray(batch.column("label")), plan)
            top = np.abs(unit).max(axis=1, keepdims=True).astype(np.float32)
            body = np.clip(np.rint(unit / top * 127), -127, 127).astype(np.int8)
            off = np.linalg.norm(unit - body * (top.astype(float) / 127), axis=1)
            scale = np.stack([top[:, 0], np.nextafter(off.astype(np.float32), np.float32(1))], axis=1)
            head = (own >> np.uint64(32)).astype(np.uint32)
            data = [scale[i].tobytes() + head[i].tobytes() + body[i].tobytes() for i in range(len(unit))]
            key = np.concatenate([own[:, :, None], probed], axis=2).reshape(len(unit), -1)
            cut = np.arange(len(unit) + 1) * key.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(data, pa.binary()), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(key.view(np.int64).ravel()))],
                ["vec_id", "data", "cells"])
    return run


def _bytes_near(blob: np.ndarray, tables: int, mine: np.ndarray, threshold: float) -> np.ndarray:
    """Which of rows ``mine`` and of all rows may reach the threshold by their bytes (8 of scales, short names, components).

    If u and v are vectors and u' and v' their bytes' values, u.v - u'.v' = u.(v - v') + (u - u').v' is at most |v - v'| + |u - u'| |v'|,
    and |v'| at most 1 + |v - v'|. Single precision adds less than an eighth of a millionth for each component.
    """
    scale = blob[:, :8].copy().view(np.float32)
    body = blob[:, 8 + 4 * tables:].view(np.int8).astype(np.float32) * (scale[:, :1] / 127)
    off = scale[:, 1]
    slack = off[mine][:, None] + off + off[mine][:, None] * off + np.float32(2e-6 + 1.25e-7 * body.shape[1])
    return body[mine] @ body.T + slack >= threshold


def _met(threshold: float, tables: int):
    """Pairs that meet in the cells of one bucket and whose bytes are near enough."""
    def run(batch: pa.Table) -> pa.Table:
        ident, cell, own, table, block, lo, hi = (np.asarray(batch.column(c).combine_chunks()) for c in ("vec_id", "cell", "own", "table", "_block", "_lo", "_hi"))
        data = batch.column("data").combine_chunks()
        meeting = mix(cell.view(np.uint64) + mix((lo * np.int64(1 << 20) + hi).view(np.uint64)) + np.asarray(pc.binary_length(data)).astype(np.uint64))
        order, raw, found = np.argsort(meeting, kind="stable"), data.to_pylist(), []
        edge = cuts(meeting[order])
        for s, e in zip(edge, edge[1:], strict=False):
            rows = order[s:e]
            if len(rows) < 2 or not own[rows].any():
                continue
            blob = np.frombuffer(b"".join([raw[r] for r in rows]), np.uint8).reshape(len(rows), -1)
            head = blob[:, 8:8 + 4 * tables].copy().view(np.uint32)
            mine = np.flatnonzero(own[rows])
            i, j = np.nonzero(_bytes_near(blob, tables, mine, threshold))
            i = mine[i]
            a, b = ident[rows[i]], ident[rows[j]]
            good = (a != b) & (~own[rows[j]] | (a < b))
            if lo[rows[0]] != hi[rows[0]]:
                good &= block[rows[i]] != block[rows[j]]
            # Where own cells agree in an earlier table, that one has the pair.
            agree = head[i] == head[j]
            good &= ~agree.any(axis=1) | (agree.argmax(axis=1) >= table[rows[0]])
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[good])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})
    return run


def _confirm(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in same_length(whole, "x")):
            cosine = (unit_rows(batch.column("x")) * unit_rows(batch.column("y"))).sum(axis=1)
            near = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in ("a", "b")], ["a", "b"])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, plan: Plan | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding, label of any type that can be grouped).

    Without a ``plan`` it is chosen by the rows of the largest label.
    """
    rows = one_row_per_id(vectors, "vec_id", "label", "embedding")
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    classes = stored(classes.select(F.col("class_id").alias("vec_id"), "label", "embedding", "copies"))
    if plan is None:
        plan = plan_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, threshold)
    members = stored(classes.select("vec_id", F.xxhash64("label").alias("label"), "embedding").mapInArrow(_members(plan), "vec_id long, data binary, cells array<long>"))
    width = PROBES + 1
    each = members.select("vec_id", F.posexplode("cells").alias("_at", "cell")).select(
        "vec_id", "cell", F.floor(F.col("_at") / width).cast("int").alias("table"), (F.col("_at") % width == 0).alias("own"))
    crowds = stored(each.groupBy("cell").agg(F.count("*").alias("_n"), F.max("own").alias("_own")).where("_n > 1 and _own").select(
        "cell", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")))
    met = each.join(crowds, "cell")
    met = met.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("long"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - F.lit(1).cast("long"))))
    met = met.select("vec_id", "cell", F.col("own"), "table", "_block", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"))
    buckets = max(partitions(vectors) * 4, members.count() * plan.tables * width // BUCKET_ROWS)
    met = met.join(members.select("vec_id", "data"), "vec_id").withColumn("bucket", F.pmod(F.xxhash64("cell", "_lo", "_hi"), F.lit(buckets)))
    pairs = met.groupBy("bucket").applyInArrow(_met(threshold, plan.tables), "a long, b long").distinct()
    full = classes.select("vec_id", "label", "embedding")
    both = pairs.join(full.withColumnsRenamed({"vec_id": "a", "label": "of_a", "embedding": "x"}), "a").join(
        full.withColumnsRenamed({"vec_id": "b", "label": "of_b", "embedding": "y"}), "b").where("of_a = of_b")  # cells know labels by a hash
    links = stored(both.select("a", "b", "x", "y").mapInArrow(_confirm(threshold), "a long, b long"))

    copies = classes.select("vec_id", "copies")
    each_way = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = each_way.join(copies.withColumnRenamed("vec_id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "vec_id")
    labels = components(links).withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    known = copies.join(others, "vec_id", "left").join(labels, "vec_id", "left").select(
        F.col("vec_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    classed = good.select("vec_id", "label", "embedding").join(
        classes.select(F.col("vec_id").alias("class_id"), "label", "embedding"), ["label", "embedding"]).select("vec_id", "class_id")
    result = rows.select("vec_id").join(classed, "vec_id", "left").join(known, "class_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
