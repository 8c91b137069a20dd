"""Ordered scans that split: sessions, ranks and running sums without one task per key.

A window over a whole contig puts that contig into one task. Every operator here works in two levels
instead: rows are reduced or ranked inside small position blocks, one summary row per block is scanned
across blocks, and the block offsets go back to the rows by an equi-join. Results equal the one-window
form exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a position block.
BLOCK_BP = 1 << 16
#: Rows of one position are ranked in blocks of this many consecutive ids, so no window outgrows it.
ID_BLOCK = 1_000_000


def gap_sessions(df: DataFrame, keys: list[str], pos: str, ident: str, max_gap: int, max_size: int,
                 block_bp: int = BLOCK_BP, id_block: int = ID_BLOCK) -> DataFrame:
    """Add ``sess`` and ``chunk``: position sessions per key, cut into chunks of at most ``max_size`` rows.

    Order is (``pos``, ``ident``). A row opens a session if it lies more than ``max_gap`` behind the
    row before it; ``chunk`` counts full chunks inside the session. Rows are first counted per position
    and id block, which collapses hot positions before anything is ordered; ``ident`` must be unique and
    non-negative for the id blocks to stay bounded. Keys, position and id must not be NULL.
    """
    columns = df.columns
    df = df.withColumn("__blk", F.floor(F.col(pos) / block_bp)).withColumn("__ib", F.floor(F.col(ident) / id_block))
    spots = df.groupBy(*keys, "__blk", pos, "__ib").agg(F.count(F.lit(1)).alias("__n"))

    key = ", ".join(keys)
    inside = f"(partition by {key}, __blk order by {pos}, __ib)"
    spots = (
        spots
        .selectExpr("*", f"if({pos} - lag({pos}) over {inside} > {max_gap}, 1, 0) as __brk", f"sum(__n) over {inside} - __n as __before")
        # Breaks so far in the block, and the row offset at which the last of them opened a session.
        .selectExpr("*", f"sum(__brk) over {inside} as __local", f"max(if(__brk = 1, __before, null)) over {inside} as __local_open")
    )
    across = f"(partition by {key} order by __blk)"
    earlier = f"(partition by {key} order by __blk rows between unbounded preceding and 1 preceding)"
    blocks = (
        spots.groupBy(*keys, "__blk").agg(
            F.min(pos).alias("__first"), F.max(pos).alias("__last"), F.sum("__n").alias("__rows"),
            F.max("__local").alias("__breaks"), F.max("__local_open").alias("__open_at"))
        .selectExpr("*", f"if(__first - lag(__last) over {across} <= {max_gap}, 0, 1) as __edge",
                    f"coalesce(sum(__rows) over {earlier}, 0) as __offset")
        # Where the session that is open at the end of a block began, as a row offset in the key.
        .selectExpr("*", f"sum(__edge + __breaks) over {across} - __breaks - 1 as __sess0",
                    "case when __breaks > 0 then __offset + __open_at when __edge = 1 then __offset end as __opened")
        .selectExpr(*keys, "__blk", "__offset", "__sess0",
                    f"if(__edge = 1, __offset, last(__opened, true) over {earlier}) as __carried")
    )
    placed = spots.join(blocks, [*keys, "__blk"]).selectExpr(
        *keys, "__blk", pos, "__ib", "__sess0 + __local as sess",
        "__offset + __before - if(__local = 0, __carried, __offset + __local_open) as __at")
    rows = df.join(placed, [*keys, "__blk", pos, "__ib"])
    rank = F.row_number().over(Window.partitionBy(*keys, "__blk", pos, "__ib").orderBy(ident))
    return (
        rows
        .withColumn("chunk", F.floor((F.col("__at") + rank - 1) / max_size))
        .select(*columns, "sess", "chunk")
    )


def ranked(df: DataFrame, name: str, major: list[Column], minor: list[Column], order: list[Column]) -> DataFrame:
    """Add ``name``: the 1-based position in the order (``major``, ``minor``, ``order``).

    ``major`` x ``minor`` name the blocks: rows are ranked inside a block, and block sizes are summed up
    in two steps (inside a major key, then over the few major keys), so no task sees all rows. The
    blocks' expressions must not be NULL.
    """
    columns = df.columns
    majors = [f"__ma{i}" for i in range(len(major))]
    minors = [f"__mi{i}" for i in range(len(minor))]
    for alias, expr in zip(majors + minors, major + minor):
        df = df.withColumn(alias, expr)
    sizes = df.groupBy(*majors, *minors).agg(F.count(F.lit(1)).alias("__n"))
    in_major = Window.partitionBy(*majors).orderBy(*minors).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__in", F.coalesce(F.sum("__n").over(in_major), F.lit(0)))
    totals = sizes.groupBy(*majors).agg(F.sum("__n").alias("__t"))
    # One row per major key (contig, evidence class): small whatever the data size.
    over_majors = Window.partitionBy(F.lit(0)).orderBy(*majors).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__t").over(over_majors), F.lit(0))).drop("__t")
    offsets = sizes.join(totals, majors).select(
        *majors, *minors, (F.col("__in") + F.col("__base")).alias("__off"))
    rows = df.join(offsets, majors + minors)
    inside = Window.partitionBy(*majors, *minors).orderBy(*order)
    return rows.withColumn(name, F.col("__off") + F.row_number().over(inside)).select(*columns, name)


def block_scan(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str, how: str = "sum",
               inclusive: bool = True) -> DataFrame:
    """Add ``name``: the running ``sum`` or ``max`` of ``value`` per key in the order (``block``, ``order``).

    Rows are scanned inside their block; what comes before a block is scanned over one row per block. Without
    ``inclusive`` a row's own value is left out, and the first row of a key has NULL.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    columns = df.columns
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    rows = df.withColumn("__v", value).withColumn("__in", fold("__v").over(inside))
    totals = rows.groupBy(*keys, block).agg(fold("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, block, fold("__t").over(before).alias("__before"))
    both = {"sum": F.coalesce(F.col("__before") + F.col("__in"), "__before", "__in"), "max": F.greatest("__before", "__in")}[how]
    return rows.join(totals, [*keys, block]).select(*columns, both.alias(name))


def block_neighbour(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str, ahead: bool) -> DataFrame:
    """Add ``name``: ``value`` of the row before (or ``ahead``) per key in the order (``block``, ``order``), NULL at the ends.

    Inside a block it is a plain neighbour; the row at a block's edge takes it from the edge of the next block that has rows.
    """
    columns = df.columns
    rows = df.withColumn("__v", F.struct(value.alias("v"))).withColumn("__o", F.struct(*order))
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    rows = rows.withColumn("__near", (F.lead if ahead else F.lag)("__v").over(inside))
    edge = rows.groupBy(*keys, block).agg((F.min_by if ahead else F.max_by)("__v", "__o").alias("__edge"))
    across = Window.partitionBy(*keys).orderBy(block)
    edge = edge.select(*keys, block, (F.lead if ahead else F.lag)("__edge").over(across).alias("__edge"))
    return rows.join(edge, [*keys, block]).select(*columns, F.coalesce("__near", "__edge")["v"].alias(name))


def merge_touching(df: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                   block_bp: int = BLOCK_BP) -> DataFrame:
    """Merge overlapping or touching intervals per key.

    An interval opens an island if it starts behind all that came before it; both the furthest end so far and the
    number of islands are scans over position blocks.
    """
    rows = df.select(*keys, start, end).distinct().withColumn("__blk", F.floor(F.col(start) / block_bp))
    rows = block_scan(rows, keys, "__blk", [start, end], F.col(end), "__reach", "max", inclusive=False)
    opens = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0)
    rows = block_scan(rows, keys, "__blk", [start, end], opens, "__island")
    return rows.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
