"""Labels, confusion counts, threshold sweep, standardisation, sampling and embedding statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import FULL_DIM
from .prefix import ranked

#: Size of the encoder's embeddings by default.
EMBED_DIM = 128
# The sweep looks at 91 thresholds from 0.05 to 0.95.
SWEEP_FIRST, SWEEP_LAST, SWEEP_COUNT = 0.05, 0.95, 91
_STEP = (SWEEP_LAST - SWEEP_FIRST) / (SWEEP_COUNT - 1)


def sweep_threshold(index: Column) -> Column:
    """Threshold number ``index`` (from 0) of the evenly spaced sweep."""
    return F.when(index == SWEEP_COUNT - 1, F.lit(SWEEP_LAST)).otherwise(index * _STEP + SWEEP_FIRST)


def label_calls(calls: DataFrame, tp_ids: DataFrame, fp_ids: DataFrame, ident: str = "call_id") -> DataFrame:
    """Add ``label``: 1 for a true-positive id, else 0 for a false-positive id; unlabelled calls drop out."""
    labels = (
        tp_ids.select(F.col("id").alias("__id"), F.lit(1).alias("label"))
        .unionByName(fp_ids.select(F.col("id").alias("__id"), F.lit(0).alias("label")))
        .groupBy("__id").agg(F.max("label").alias("label"))
    )
    return calls.join(labels, calls[ident].cast("string") == labels["__id"].cast("string")).drop("__id")


def _metrics(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision = tp / F.greatest(F.lit(1), tp + fp)
    recall = tp / F.greatest(F.lit(1), tp + fn)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2.0 * precision * recall / (precision + recall))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def confusion(scored: DataFrame, threshold: float, y: str = "y_true", prob: str = "prob") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 at a threshold."""
    hit = F.col(prob) >= float(threshold)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    counts = scored.agg(total((F.col(y) == 1) & hit).alias("tp"), total((F.col(y) == 0) & hit).alias("fp"),
                        total((F.col(y) == 1) & ~hit).alias("fn"))
    return counts.select("tp", "fp", "fn", *_metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def _passed_thresholds(prob: Column) -> Column:
    """Number of sweep thresholds at or below a probability, exact against their double values."""
    guess = F.floor((prob - SWEEP_FIRST) / _STEP)

    def reached(index: Column) -> Column:
        return F.when(sweep_threshold(index) <= prob, 1).otherwise(0)

    # The guess is off by one at most; thresholds rise, so counting the neighbours settles it.
    count = guess - 1 + reached(guess - 1) + reached(guess) + reached(guess + 1)
    return F.greatest(F.lit(0), F.least(F.lit(SWEEP_COUNT), count))


def threshold_metrics(scored: DataFrame, y: str = "y_true", prob: str = "prob") -> DataFrame:
    """Metrics of all sweep thresholds from one pass.

    Records are counted by how many thresholds they reach (at most 92 groups per label); running sums
    over these counts give the confusion counts of every threshold without pairing rows and thresholds.
    """
    counts = scored.groupBy(_passed_thresholds(F.col(prob)).cast("int").alias("reached")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))
    grid = scored.sparkSession.range(0, SWEEP_COUNT + 1, 1, 1).select(F.col("id").cast("int").alias("reached"))
    filled = grid.join(counts, "reached", "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(F.lit(0)).orderBy(F.col("reached").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    swept = (
        filled.withColumn("tp", F.sum("pos").over(above)).withColumn("fp", F.sum("neg").over(above))
        .withColumn("fn", F.sum("pos").over(everything) - F.col("tp"))
        .where(F.col("reached") > 0)
        .withColumn("threshold", sweep_threshold(F.col("reached") - 1))
    )
    return swept.select("threshold", "tp", "fp", "fn", *_metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def select_threshold(scored: DataFrame, y: str = "y_true", prob: str = "prob") -> DataFrame:
    """The best threshold: largest f1, then precision, then recall, then the lowest threshold."""
    return threshold_metrics(scored, y, prob).orderBy(
        F.col("f1").desc(), F.col("precision").desc(), F.col("recall").desc(), "threshold").limit(1)


def _per_dimension(df: DataFrame, vector: str, dim: int, **aggregates: str) -> DataFrame:
    """(dim, aggregates...) per element of a vector column.

    Every element is an aggregate of its own over the unexploded rows; the one result row is then turned.
    """
    arrays = [F.expr("array(" + ", ".join(text.format(x=f"{vector}[{i}]") for i in range(dim)) + ")").alias(name)
              for name, text in aggregates.items()]
    packed = df.agg(*arrays)
    return packed.select(F.posexplode(F.arrays_zip(*aggregates)).alias("dim", "v")).select("dim", "v.*")


def feature_stats(df: DataFrame, vector: str = "feat", dim: int = FULL_DIM) -> DataFrame:
    """(dim, mean, scale) per vector element; a scale below 1e-6 counts as 1."""
    stats = _per_dimension(df, vector, dim, mean="avg({x})", scale="stddev_pop({x})")
    return stats.select("dim", "mean", F.when(F.col("scale") < 1e-6, 1.0).otherwise(F.col("scale")).alias("scale"))


def standardise(df: DataFrame, stats: DataFrame, vector: str = "feat", out: str = "z") -> DataFrame:
    """Add the z-scores of a vector column. ``stats`` has one row per dimension, so its packed form is one row."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "scale"))).alias("__stats"))
    z = F.zip_with(F.col(vector), F.col("__stats"), lambda x, s: (x - s["mean"]) / F.greatest(s["scale"], F.lit(1e-6)))
    return df.withColumn("__stats", packed.scalar()).withColumn(out, z).drop("__stats")


def sample_records(df: DataFrame, n: int, ident: str = "sid", seed: int = 42) -> DataFrame:
    """At most ``n`` records drawn without replacement, reproducibly: the smallest keyed hashes.

    Records are ranked block by block of their hash, so no task holds the sample.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")))
    drawn = df.withColumn("__draw", draw)
    major, minor = F.substring("__draw", 1, 2), F.substring("__draw", 3, 2)
    placed = ranked(drawn, "__no", [major], [minor], [F.col("__draw"), F.col(ident)])
    return placed.where(F.col("__no") <= int(n)).drop("__draw", "__no")


def embedding_stats(df: DataFrame, vector: str = "emb", dim: int = EMBED_DIM) -> DataFrame:
    """One row: mean per-dimension population std, and mean absolute value."""
    per_dim = _per_dimension(df, vector, dim, sd="stddev_pop({x})", s="sum(abs({x}))", n="count({x})")
    return per_dim.agg(F.avg("sd").alias("embedding_std_mean"), (F.sum("s") / F.sum("n")).alias("embedding_abs_mean"))
