"""CIGAR strings and read sequences as column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = r"\d+[MIDNSHP=X]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cigar_items(cigar: Column) -> Column:
    """Array of structs (len, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(_ITEM), F.lit(0)), lambda item: F.struct(
        F.substring(item, F.lit(1), F.length(item) - 1).cast("bigint").alias("len"),
        F.substring(item, F.lit(-1), F.lit(1)).alias("op")))


def span_of_ops(items: Column, ops: str) -> Column:
    """Total length of the items whose operation is one of ``ops``."""
    wanted = list(ops)
    return F.aggregate(items, F.lit(0).cast("bigint"),
                       lambda acc, it: acc + F.when(it["op"].isin(wanted), it["len"]).otherwise(F.lit(0)))


def reference_span(items: Column) -> Column:
    return span_of_ops(items, "MD=XN")


def query_span(items: Column) -> Column:
    return span_of_ops(items, "MIS=X")


def _edge_clip(items: Column, index: int, ops: str) -> Column:
    edge = F.try_element_at(items, F.lit(index))
    return F.when(edge["op"].isin(list(ops)), edge["len"]).otherwise(F.lit(0).cast("bigint"))


def leading_clip(items: Column, ops: str = "S") -> Column:
    return _edge_clip(items, 1, ops)


def trailing_clip(items: Column, ops: str = "S") -> Column:
    return _edge_clip(items, -1, ops)


def clip_and_bias(cigar: Column) -> Column:
    """Struct (left, right, bias): soft clips at both ends, and reference length over M, D, =, X."""
    return let(cigar_items(cigar), lambda items: F.struct(
        leading_clip(items).alias("left"),
        trailing_clip(items).alias("right"),
        span_of_ops(items, "MD=X").alias("bias"),
    ))


def indel_hits(items: Column, pos0: Column, min_len: int) -> Column:
    """Array of structs (op, pos, len, read_end): the I and D items of at least ``min_len``.

    ``read_end`` is the read offset behind an insertion. The offset moves on every operation but D, and
    a leading hard clip is taken off first. One fold keeps the state; only hits are appended.
    """
    none = F.array().cast("array<struct<op:string,pos:bigint,len:bigint,read_end:bigint>>")

    def step(acc: Column, item: Column) -> Column:
        length, op = item["len"], item["op"]
        read = acc["read"] + F.when(op == "D", F.lit(0)).otherwise(length)
        hit = op.isin("I", "D") & (length >= min_len)
        found = F.struct(op.alias("op"), acc["ref"].alias("pos"), length.alias("len"), read.alias("read_end"))
        return F.struct(
            (acc["ref"] + F.when(op.isin("M", "D", "=", "X", "N"), length).otherwise(F.lit(0))).alias("ref"),
            read.alias("read"),
            F.when(hit, F.concat(acc["hits"], F.array(found))).otherwise(acc["hits"]).alias("hits"),
        )

    def walk(parsed: Column) -> Column:
        start = F.struct(pos0.cast("bigint").alias("ref"), (-leading_clip(parsed, "H")).alias("read"), none.alias("hits"))
        return F.aggregate(parsed, start, step, lambda acc: acc["hits"])

    return let(items, walk)


def merge_read_hits(hits: Column, max_distance: int, from_end: bool) -> Column:
    """Join nearby hits of one read: array of structs (pos, len, seq) in read order.

    ``hits`` holds structs (pos, len, seq). A hit joins the running one if it starts within
    ``max_distance`` of the last joined position (insertions) or of its end (deletions, ``from_end``).
    """
    merged = "array<struct<pos:bigint,len:bigint,seq:string,last:bigint>>"

    def step(acc: Column, hit: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        reach = hit["pos"] + (hit["len"] if from_end else F.lit(0))
        joined = F.struct(
            last["pos"].alias("pos"),
            (last["len"] + hit["len"]).alias("len"),
            F.concat(last["seq"], hit["seq"]).alias("seq"),
            reach.alias("last"),
        )
        fresh = F.struct(hit["pos"].alias("pos"), hit["len"].alias("len"), hit["seq"].alias("seq"), reach.alias("last"))
        joins = (F.size(acc) > 0) & (hit["pos"] - last["last"] <= max_distance)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))) \
            .otherwise(F.concat(acc, F.array(fresh)))

    folded = F.aggregate(hits, F.array().cast(merged), step)
    return F.transform(folded, lambda h: F.struct(h["pos"].alias("pos"), h["len"].alias("len"), h["seq"].alias("seq")))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def slice_text(text: Column, begin: Column, end: Column) -> Column:
    """Text from ``begin`` to ``end`` (0-based, half-open); negative bounds count from the end."""
    size = F.length(text)

    def bound(value: Column) -> Column:
        return F.when(value < 0, F.greatest(value + size, F.lit(0))).otherwise(F.least(value, size))

    first, last = bound(begin), bound(end)
    return F.substring(text, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))
