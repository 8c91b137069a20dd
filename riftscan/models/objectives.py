"""Training objectives as statistics: views with noise and dropped features, and the loss terms over tables of vectors.

Nothing is learned here. A training framework can be checked against these figures, and a finished encoder judged by them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of rows that a class loss leaves out.
IGNORED = -100


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _unit(digest: Column, at: int, digits: int) -> Column:
    """A number in [0, 1) from hexadecimal digits."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long") / F.lit(16.0**digits)


def augmented(ident: Column, vector: Column, view: int, noise_scale: float, feature_dropout: float, seed: int) -> Column:
    """One view of a vector: normal noise of the given scale, then features set to zero with the given chance.

    Random numbers are counter based: one MD5 of (seed, view, id, place) gives two uniform numbers for a normal deviate
    and one for the mask, so a view is the same whatever the partitions and however often a task runs.
    """
    prefix = F.concat_ws("|", F.lit(f"{seed}|{view}"), ident.cast("string"))

    def one(x: Column, i: Column) -> Column:
        def use(h: Column) -> Column:
            radius = F.sqrt(-2 * F.log(1 - _unit(h, 1, 13)))
            noisy = x.cast("double") + F.lit(float(noise_scale)) * radius * F.cos(2 * math.pi * _unit(h, 14, 13))
            return F.when(_unit(h, 27, 6) >= F.lit(float(feature_dropout)), noisy).otherwise(F.lit(0.0))
        return _once(F.md5(F.concat_ws("|", prefix, i.cast("string"))), use)

    return F.transform(vector, one)


def with_views(df: DataFrame, ident: str, vector: str, noise_scale: float = 0.1, feature_dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """``df`` with view_1 and view_2 of ``vector``; a null vector has null views."""
    return df.withColumns({f"view_{v}": augmented(F.col(ident), F.col(vector), v, noise_scale, feature_dropout, seed) for v in (1, 2)})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(-1, dim)


def _gram(dim: int, means: np.ndarray):
    """A task's sums of products of centred components: one row for each component of each view, and the squared difference."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, apart, rows = np.zeros((2, dim, dim)), 0.0, 0
        for batch in batches:
            one, two = (_matrix(batch.column(i), dim) for i in (0, 1))
            rows += len(one)
            apart += float(((one - two) ** 2).sum())
            for k, x in enumerate((one - means[0], two - means[1])):
                sums[k] += x.T @ x
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([1, 2], dim)), pa.array(np.tile(np.arange(dim), 2)), pa.array(sums.reshape(2 * dim, dim).tolist(), pa.list_(pa.float64())),
                pa.array([apart] + [0.0] * (2 * dim - 1)), pa.array([rows] + [0] * (2 * dim - 1))], ["view", "i", "products", "apart", "rows"])
    return run


def gram(df: DataFrame, view_1: str, view_2: str, dim: int) -> DataFrame:
    """Centred sums of products of both views: (view, i, products array, apart, rows), one row for each view and component.

    Tasks add up blocks of outer products, so what is shuffled is ``dim`` x ``dim`` numbers a task, whatever its rows.
    Rows where a view is null or has another length are left out.
    """
    both = df.select(F.col(view_1).cast("array<double>").alias("a"), F.col(view_2).cast("array<double>").alias("b")).where(
        (F.size("a") == dim) & (F.size("b") == dim))
    first = both.agg(*(F.avg(F.col(c)[i]) for c in ("a", "b") for i in range(dim))).first()
    means = np.array([x or 0.0 for x in first]).reshape(2, dim)
    parts = both.mapInArrow(_gram(dim, means), "view long, i long, products array<double>, apart double, rows long")
    added = F.array(*(F.sum(F.col("products")[j]) for j in range(dim)))
    return parts.groupBy("view", "i").agg(added.alias("products"), F.sum("apart").alias("apart"), F.sum("rows").alias("rows"))


def vicreg_terms(df: DataFrame, view_1: str, view_2: str, dim: int, gamma: float = 1.0, lambda_var: float = 25.0, lambda_cov: float = 1.0) -> DataFrame:
    """One row: rows, invariance, variance, covariance and their weighted sum (loss); without rows only a zero count.

    Invariance is the mean squared difference of the views. Variance asks every component for a standard deviation of
    ``gamma``. Covariance is the squared sum off the diagonal, by component; with one row it is zero.
    """
    sums = gram(df, view_1, view_2, dim)
    whole = sums.agg(F.sum("rows").alias("n"), (F.sum("apart") / F.sum("rows") / dim).alias("invariance"))
    off = F.aggregate(F.transform("products", lambda x, j: F.when(j == F.col("i"), 0.0).otherwise(x * x)), F.lit(0.0), lambda s, x: s + x)
    each = sums.select(F.col("products")[F.col("i")].alias("square"), off.alias("off")).crossJoin(F.broadcast(whole.select("n")))  # one row
    terms = each.agg(
        (F.sum(F.greatest(F.lit(0.0), F.lit(float(gamma)) - F.sqrt(F.col("square") / F.col("n") + 1e-4))) / dim).alias("variance"),
        (F.sum(F.when(F.col("n") > 1, F.col("off") / F.pow(F.col("n") - 1, F.lit(2))).otherwise(0.0)) / dim).alias("covariance"))
    joined = whole.crossJoin(terms)  # one row each
    loss = F.col("invariance") + lambda_var * F.col("variance") + lambda_cov * F.col("covariance")
    return joined.select(F.coalesce("n", F.lit(0)).alias("rows"), "invariance", "variance", "covariance", loss.alias("loss"))


def type_cross_entropy(df: DataFrame, logits: str, label: str, ignored: int = IGNORED) -> DataFrame:
    """(label, n, loss, accuracy) of every class, and of all with a null label: cross entropy of ``logits`` and hits of the largest.

    Rows whose label is null, ``ignored`` or no place of the logits are left out; ties go to the first of the largest.
    """
    rows = df.select(F.col(logits).alias("x"), F.col(label).alias("y")).where((F.col("y") != ignored) & (F.col("y") >= 0) & (F.col("y") < F.size("x")))
    top = rows.withColumn("top", F.array_max("x").cast("double"))
    spread = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - F.col("top")))
    each = top.select(F.col("y").cast("int").alias("label"), (F.log(spread) + F.col("top") - F.get("x", F.col("y").cast("int")).cast("double")).alias("loss"),
                      (F.array_position("x", F.array_max("x")) - 1 == F.col("y")).cast("int").alias("hit"))
    return each.rollup("label").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), F.avg("hit").alias("accuracy"))
