"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by a permutation of its own (an offset and a stride from hashes
of its name). Shards take turns, in the order of their names; on its turn a shard claims the first free slot of its
order. Shards then own equal numbers of slots, give or take one, and when a shard comes or goes few slots change
hands. A row's slot is a hash of its key modulo the table's size; finding its shard is one look into a broadcast
table whose size is a parameter and doesn't grow with the data.

Writing one file set per shard would put a shard's rows into one task; ``write`` salts each shard over as many tasks
as its share of the rows asks for. Keys that are null share a slot of their own (hash of ``~``); equal keys, and so
repeated rows, always meet in one shard. Other columns, empty and long texts are carried along; columns that are
called slot, shard or shard_name are replaced. An empty table gives
an empty table. Shard names are deduplicated; without names nothing can be placed and ValueError says so.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import named_as, plain_names

#: Slots: a prime, about 256 for each of sixteen shards.
TABLE_SIZE = 4099


def number(text: str) -> int:
    """60 bits of a hash of a text, as ``slot`` and SQL take them from an MD5 in hexadecimal."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and stride of a shard's order of the slots."""
    return number(f"{name}|offset") % size, number(f"{name}|skip") % (size - 1) + 1


def fill(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index (in sorted order) of the shard that claimed it."""
    names = sorted(set(shards))
    if not names:
        raise ValueError("at least one shard is needed")
    if size < len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime not below the number of shards")
    orders = []
    for name in names:
        offset, skip = preference(name, size)
        orders.append((offset + skip * np.arange(size, dtype=np.int64)) % size)
    table = np.full(size, -1, np.int32)
    upto = [0] * len(names)
    for turn in range(size):
        k = turn % len(names)
        while table[orders[k][upto[k]]] >= 0:
            upto[k] += 1
        table[orders[k][upto[k]]] = k
    return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard (index) and shard_name: ``size`` rows."""
    names = sorted(set(shards))
    return spark.createDataFrame([(i, int(k), names[k]) for i, k in enumerate(fill(shards, size))], "slot long, shard int, shard_name string")


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("~")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with slot, shard and shard_name."""
    lookup = table_frame(df.sparkSession, shards, size)
    spot = slot(F.col(key), size)
    named = df.withColumn("__key", spot) if key in lookup.columns else df  # a key that is replaced is read before
    rest = named.drop(*lookup.columns)
    plain = plain_names(rest, "__key" if named is not df else key)
    keyed = plain.withColumnRenamed("__key", "__slot") if named is not df else plain.withColumn("__slot", spot)
    joined = keyed.join(F.broadcast(lookup), keyed["__slot"] == lookup["slot"]).drop("__slot")  # ``size`` rows
    return named_as(joined, df.drop(*lookup.columns))


def write(df: DataFrame, key: str, shards: list[str], path: str, rows_per_task: int = 5_000_000, size: int = TABLE_SIZE) -> None:
    """One folder for each shard; a shard is written by as many tasks as its rows ask for."""
    placed = place(df, key, shards, size)
    sizes = placed.groupBy("shard").count().select("shard", F.ceil(F.col("count") / rows_per_task).cast("int").alias("_tasks"))
    salted = placed.join(F.broadcast(sizes), "shard")  # one row for each shard
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.col("_tasks")))
    salted.repartition("shard", "_salt").drop("_tasks", "_salt", "slot", "shard_name").write.partitionBy("shard").parquet(path)


def moved(before: list[str], after: list[str], size: int = TABLE_SIZE) -> float:
    """Share of the slots that change hands from one set of shards to another."""
    a, b = (np.array(sorted(set(s)))[fill(s, size)] for s in (before, after))
    return float((a != b).mean())
