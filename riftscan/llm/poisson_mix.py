"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, where k inverts the Poisson distribution with mean
target documents of s / documents of s at a number in [0, 1) that a hash of the seed and the document's id gives. A
mean above MEAN_STEP is split into equal parts with a number of their own, whose counts add up. Copies are then
shuffled globally: a hash of seed, id and copy deals them to partitions and orders them inside.

Counts per source are one combined aggregate, so a source with a third of all rows costs no more than any other. The
table of sources is counted first and broadcast up to BROADCAST_SOURCES rows. Nothing depends on
partitions or order: the same seed gives the same copies. No Python runs in any of this.

A null source is a source of its own and may have a weight under None. Sources without a weight, or with 0, give no
copies. Rows with a null or repeated id: the copies of equal ids agree, a null id counts as one more id. Nulls, empty
and long texts elsewhere are carried along. An empty table gives an empty table. Columns of ``docs`` may have any
names; ``mix`` replaces columns called ``replica`` or ``order_key`` by its own, ``replicate`` adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import named_as, plain_names

MEAN_STEP = 16.0
#: Sources up to which their table is sent to every task (it was counted); beyond that it is joined by shuffling.
BROADCAST_SOURCES = 20_000


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash; nulls hash as ``~``."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / float(2**52)


def poisson_steps(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a mean of at most MEAN_STEP, until nothing is left."""
    terms = int(MEAN_STEP + 12 * MEAN_STEP ** 0.5 + 24)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("steps"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), start,
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), (a["sum"] + a["p"] * mean / k).alias("sum"),
                              F.concat(a["steps"], F.array(a["sum"] + a["p"] * mean / k)).alias("steps")),
        lambda a: a["steps"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None, total: int | None, source: str = "source") -> DataFrame:
    """source, rate (mean copies of each document), parts and steps; one row for each source with a weight.

    ``weights`` need not add up to 1; without any, all sources weigh the same. ``total``: documents wanted, by default as many as there are.
    """
    counts = docs.select(F.col(source).alias("_source")).groupBy("_source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        counts = counts.withColumn("weight", weight).where("weight > 0")
    weight_sum, rows, sources = counts.agg(F.sum("weight"), F.sum("n"), F.count("*")).first()
    wanted = float(total if total is not None else docs.count() if weights is not None else rows or 0)
    rate = counts.select("_source", (F.col("weight") / float(weight_sum or 1) * wanted / F.col("n")).alias("rate"))
    rate = rate.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP).cast("int")))
    rate = rate.withColumn("steps", poisson_steps(F.col("rate") / F.col("parts")))
    return F.broadcast(rate) if sources <= BROADCAST_SOURCES else rate


def copies(ident: Column, parts: Column, steps: Column, seed: int) -> Column:
    """The document's number of copies: how many steps its numbers reach. Each number is drawn once, before it is compared."""
    draws = F.transform(F.sequence(F.lit(1), parts), lambda part: unit(F.lit(seed), F.lit("copies"), part, ident))
    return F.aggregate(draws, F.lit(0), lambda total, draw: total + F.size(F.filter(steps, lambda step: step <= draw)))


def _each(docs: DataFrame, weights, total, seed: int, ident: str, source: str) -> DataFrame:
    rate = rates(docs, weights, total, source).withColumnsRenamed({c: f"__mix_{c}" for c in ("rate", "parts", "steps")})
    joined = docs.join(rate, docs[source].eqNullSafe(rate["_source"]))
    counted = joined.select(*(docs[c] for c in docs.columns), copies(docs[ident], rate["__mix_parts"], rate["__mix_steps"], seed).alias("__mix_copies"))
    each = counted.where("__mix_copies > 0").withColumn("__mix_replica", F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1)))
    each = each.withColumn("__mix_order", unit(F.lit(seed), F.lit("order"), F.col("__mix_replica"), F.col(ident))).drop("__mix_copies")
    return each.repartition("__mix_order").sortWithinPartitions("__mix_order", ident)


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 1,
              ident: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with every row once for each of its copies, globally shuffled; no other columns."""
    plain = plain_names(docs, ident, source)
    return named_as(_each(plain, weights, total, seed, ident, source).select(*plain.columns), docs)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 1,
        ident: str = "doc_id", source: str = "source") -> DataFrame:
    """As ``replicate``, with replica (from 0) and order_key, by which the copies of a partition are ordered."""
    own = {"replica": "__mix_replica", "order_key": "__mix_order"}
    docs = docs.drop(*own)
    mixed = _each(plain_names(docs, ident, source), weights, total, seed, ident, source)
    return named_as(mixed.withColumnsRenamed({v: k for k, v in own.items()}), docs)
