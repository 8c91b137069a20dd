"""Tables in the shared folder, and which keys more than one owner has."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .text import give_back, mix

#: Keys that one group of ``shared_keys`` holds on average.
GROUP_KEYS = 400_000


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that spark.checkpoint.dir names, so later steps don't repeat it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, so that a long run's folder doesn't fill."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; of columns that share a name the first counts. Ids come as long numbers."""
    seen: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        seen.setdefault(name, f"_{i}")
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).select(
        *((F.col(seen[n]).cast("long") if n.endswith("_id") else F.col(seen[n])).alias(n) for n in names))


def plain_names(df: DataFrame, *roles: str) -> DataFrame:
    """``df`` with names that can't clash: the first column of each role keeps its name, all others are numbered.

    For operators that carry columns along: names may hold dots, repeat, or be those that the operator uses itself.
    ``named_as`` gives the old names back.
    """
    names, left = [], set(roles)
    for i, name in enumerate(df.columns):
        names.append(name if name in left else f"_c{i}")
        left.discard(name)
    return df.toDF(*names)


def named_as(out: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df`` under their names, and what ``out`` has behind them."""
    return out.toDF(*df.columns, *out.columns[len(df.columns):])


def one_row_per_id(df: DataFrame, ident: str, *names: str) -> DataFrame:
    """Columns ``ident`` and ``names`` without null ids; of rows that share an id the largest by ``names``, nulls lowest.

    Whether any id is repeated is asked of the ids alone, so that a table with unique ids isn't shuffled for it.
    """
    df = columns_of(df, ident, *names).where(F.col(ident).isNotNull())
    if df.groupBy(ident).count().where("count > 1").isEmpty():
        return df
    largest = df.groupBy(ident).agg(F.max(F.struct(*names)).alias("_row"))
    return largest.select(ident, *(F.col("_row")[n].alias(n) for n in names))


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Group and 32 bits of each key: what travels. Groups have a bounded mean size, so two keys of one group rarely agree."""
    return ((mix(keys) % np.uint64(buckets)) << np.uint64(32) | keys >> np.uint64(32)).view(np.int64)


def cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def flat(table: pa.Table, name: str) -> np.ndarray:
    """All entries of a list column."""
    return np.asarray(pa.concat_arrays(table.column(name).chunks).flatten())


def in_blocks(df: DataFrame, group: str, ident: str, size: int) -> DataFrame:
    """Rows of groups of two or more, dealt so that every two rows of a group meet once.

    A group is cut into blocks of about ``size`` rows (by a hash of ``ident``); a row comes once for each block of its
    group, with the pair of blocks (``_lo``, ``_hi``) that meets there and its own (``_block``). So no task sees more
    than two blocks of a group at once, whatever its size. Rows come dealt by group and pair of blocks: what was dealt by
    the group alone would keep all blocks of a hot group in one task.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1")
    cut = df.join(counts, group).withColumn("_blocks", F.ceil(F.col("_n") / size).cast("int"))
    cut = cut.withColumn("_block", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
    each = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.select(*df.columns, F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), "_block").repartition(group, "_lo", "_hi")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links between small numbers a and b that join what earlier ones left apart."""
    top = list(range(int(max(a.max(), b.max())) + 1)) if len(a) else []
    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        while top[y] != y:
            top[y] = top[top[y]]
            y = top[y]
        if x != y:
            top[y] = x
            keep.append(k)
    return a[keep], b[keep]


#: Keys that a task sorts at once.
_SORTED_KEYS = 1 << 18


def _few_keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    piece = np.asarray(batch.column(1).offsets)[:-1] // _SORTED_KEYS
    edges = cuts(piece)
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)
    give_back()


def _pack(buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _few_keys(whole)):
            lists = batch.column(1)
            owner = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(lists.offsets)))
            key = short_keys(np.asarray(lists.flatten()).view(np.uint64), buckets)
            if not len(key):
                continue
            order = np.lexsort((owner, key))
            owner, key = owner[order], key[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
            owner, key = owner[fresh], key[fresh]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(head) - 1
            known = np.bincount(group)[group] > 1
            yield _rows(key[head] >> 32, key[head], owner[head], known[head])
            if known.any():
                mine = (mix(owner[known].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield _rows(-1 - mine, key[known], owner[known], np.ones(int(known.sum()), bool))
    return pack


def _rows(bucket: np.ndarray, key: np.ndarray, owner: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((owner, bucket))
    bucket, key, owner, known = bucket[order], key[order], owner[order], known[order]
    first = cuts(bucket)
    one = cuts(owner + bucket * np.int64(0x5851F42D4C957F2D))  # an owner is written once for all its keys in a group
    entries = np.searchsorted(one, first)
    cut = pa.array(first.astype(np.int32))
    few = pa.array(entries.astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[first[:-1]]),
        pa.ListArray.from_arrays(cut, pa.array((key & 0xFFFFFFFF).astype(np.uint32).view(np.int32))),
        pa.ListArray.from_arrays(cut, pa.array(known)),
        pa.ListArray.from_arrays(few, pa.array(owner[one[:-1]])),
        pa.ListArray.from_arrays(few, pa.array(np.diff(one).astype(np.int32))),
        pa.ListArray.from_arrays(cut, pa.array((key >> 32).astype(np.int32))) if bucket[0] < 0 else pa.array([[]] * (len(first) - 1), pa.list_(pa.int32()))],
        ["bucket", "keys", "known", "owners", "counts", "groups"])


def _answer(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    low = flat(table, "keys").view(np.uint32).astype(np.int64)
    owner = np.repeat(flat(table, "owners"), flat(table, "counts"))
    if bucket >= 0:
        _, group, count = np.unique(low, return_inverse=True, return_counts=True)
        told = (count[group] > 1) & ~flat(table, "known")
        key, owner = low[told] | np.int64(bucket) << 32, owner[told]
    else:
        key = low | flat(table, "groups").astype(np.int64) << 32
    return pa.table({"owner": owner, "key": key})


def buckets_for(df: DataFrame, keys: float) -> int:
    """Groups for so many keys: at least as many as the session shuffles into."""
    return max(partitions(df), int(keys / GROUP_KEYS) + 1)


def shared_keys(df: DataFrame, buckets: int) -> DataFrame:
    """Of (owner long, keys array<long>), the keys that at least two owners have: (owner, keys as ``short_keys``).

    Owners without such a key have no row. Keys travel in packed rows, one for each batch and group of keys, cut to
    32 bits inside their group: a filter that lets a few keys in ten thousand through by chance and loses none.
    What two owners of one batch share is known there, and only one of them asks the others: a key that a third
    of all owners have comes to its group once a batch, not once an owner. The number of groups grows with the
    number of keys, so a group's size doesn't.
    """
    packed = df.select("owner", "keys").where("owner is not null and size(keys) > 0").mapInArrow(
        _pack(buckets), "bucket long, keys array<int>, known array<boolean>, owners array<long>, counts array<int>, groups array<int>")
    told = packed.groupBy("bucket").applyInArrow(_answer, "owner long, key long")
    return told.groupBy("owner").agg(F.array_distinct(F.collect_list("key")).alias("keys"))
