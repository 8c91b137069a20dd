"""Call scorer: a small one-dimensional convolutional network over the score features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calls import SCORE_FEATURES, drop_counters
from ..operators.evaluate import label_calls
from .encoder import load_weights, matrix_of
from .layers import sigmoid

# Scorer inputs and the checkpoint kind.
SCORER_FEATURES = (*SCORE_FEATURES, "domain_real", "domain_sim")
MODEL_TYPE = "cnn_scorer_v1"
_NORM_EPS = 1e-5
_DOMAIN_HINTS = ("dataset_name", "__source_name__", "source_name", "call_id")


def windows(x: np.ndarray) -> np.ndarray:
    """(batch, channels, length) to (batch, length, channels x 3): the width-3 neighbourhoods, zero padded."""
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1)))
    stacked = np.stack([padded[:, :, i:i + x.shape[2]] for i in range(3)], axis=-1)
    return stacked.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)


def halve(x: np.ndarray) -> np.ndarray:
    """Max pooling of width and step two; an odd last element is dropped."""
    n = x.shape[2] // 2
    return x[:, :, :2 * n].reshape(x.shape[0], x.shape[1], n, 2).max(axis=3)


def scorer_forward(weights: dict, x: np.ndarray) -> np.ndarray:
    """Logits of a batch of standardised feature rows, with stored normalisation statistics."""
    if x.ndim != 2:
        raise ValueError(f"expected rows of features, got shape {x.shape}")
    h = x[:, None, :]
    depth = sum(1 for k in weights if k.startswith("c") and k.endswith(".w"))
    for i in range(depth):
        w = weights[f"c{i}.w"]
        h = (windows(h) @ w.reshape(w.shape[0], -1).T + weights[f"c{i}.b"]).transpose(0, 2, 1)
        scale = weights[f"c{i}.gain"] / np.sqrt(weights[f"c{i}.var"] + _NORM_EPS)
        h = np.maximum(0.0, (h - weights[f"c{i}.mean"][:, None]) * scale[:, None] + weights[f"c{i}.shift"][:, None])
        if i < depth - 1:
            h = halve(h)
    pooled = np.concatenate([h.mean(axis=2), h.max(axis=2)], axis=1)
    hidden = np.maximum(0.0, pooled @ weights["d0.w"].T + weights["d0.b"])
    return (hidden @ weights["d1.w"].T + weights["d1.b"])[:, 0]


def import_state(state: dict) -> dict:
    """Weights from a checkpoint's named arrays, current or legacy names.

    Convolutions and their norms are told apart by shape and order, dense layers likewise; legacy
    checkpoints only differ in prefixes and numbering, which the order makes irrelevant.
    """
    body: dict[int, dict] = {}
    head: dict[int, dict] = {}
    for key, value in state.items():
        parts = key.removeprefix("backbone.").split(".")
        if len(parts) == 3 and parts[1].isdigit() and parts[0] in ("net", "head"):
            target = body if parts[0] == "net" else head
            target.setdefault(int(parts[1]), {})[parts[2]] = np.asarray(value, dtype=np.float64)
    blocks = [body[i] for i in sorted(body)]
    convolutions = [b for b in blocks if b["weight"].ndim == 3]
    norms = [b for b in blocks if b["weight"].ndim == 1]
    dense = [head[i] for i in sorted(head) if head[i]["weight"].ndim == 2]
    weights = {}
    for i, (conv, norm) in enumerate(zip(convolutions, norms)):
        weights |= {f"c{i}.w": conv["weight"], f"c{i}.b": conv["bias"], f"c{i}.gain": norm["weight"],
                    f"c{i}.shift": norm["bias"], f"c{i}.mean": norm["running_mean"], f"c{i}.var": norm["running_var"]}
    for i, layer in enumerate(dense):
        weights |= {f"d{i}.w": layer["weight"], f"d{i}.b": layer["bias"]}
    return weights


def load_scorer(path: str) -> dict:
    """Scorer model: weights, feature names, mean, scale and thresholds."""
    weights, info = load_weights(path)
    if str(info.get("model_type", "")).lower() != MODEL_TYPE:
        raise ValueError(f"a {MODEL_TYPE} checkpoint is needed: {path}")
    arrays = weights if "d0.w" in weights else import_state(weights)
    return {**info, "weights": arrays}


def resolve_threshold(model: dict, platform: str | None = None, override: float | None = None) -> tuple[float, str]:
    """Decision threshold and where it comes from: override, platform, checkpoint, default."""
    if override is not None:
        return float(override), "cli_override"
    per_platform = model.get("platform_thresholds") or {}
    key = str(platform).lower() if platform else None
    if key in per_platform:
        return float(per_platform[key]), f"platform_threshold:{key}"
    if "threshold" in model:
        return float(model["threshold"]), "scorer_payload"
    return 0.5, "default"


def record_domain(df: DataFrame) -> Column:
    """real or sim: the explicit domain, else ``sim`` wherever a naming field says so."""
    explicit = F.lower(F.btrim("domain")) if "domain" in df.columns else F.lit(None).cast("string")
    hints = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _DOMAIN_HINTS if c in df.columns]
    named = F.lower(F.concat_ws(" ", *hints)).contains("sim") if hints else F.lit(False)
    return F.when(explicit.isin("real", "sim"), explicit).when(named, F.lit("sim")).otherwise(F.lit("real"))


def vectorise_records(df: DataFrame, names=SCORER_FEATURES, out: str = "x") -> DataFrame:
    """Add the ordered feature vector of every record; missing and NULL features count as 0."""
    domain = record_domain(df)

    def value(name: str) -> Column:
        if name in ("domain_real", "domain_sim"):
            return F.when(domain == name.removeprefix("domain_"), F.lit(1.0)).otherwise(F.lit(0.0))
        return F.coalesce(F.col("score_features")[name].cast("double"), F.lit(0.0))

    return df.withColumn(out, F.array(*[value(n) for n in names]))


def predict(df: DataFrame, model: dict, vector: str = "x", out: str = "scorer_prob") -> DataFrame:
    """Add the probability of every record."""
    shared = df.sparkSession.sparkContext.broadcast(
        (model["weights"], np.asarray(model["mean"], dtype=np.float64), np.asarray(model["scale"], dtype=np.float64)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean, scale = shared.value
        for batch in batches:
            rows = (matrix_of(batch.column(at)) - mean) / np.maximum(scale, 1e-6) if batch.num_rows else None
            probs = sigmoid(scorer_forward(weights, rows)) if rows is not None else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probs)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def score_calls(calls: DataFrame, model: dict) -> DataFrame:
    """Calls with ``scorer_prob``; ``prob`` becomes the larger of itself and the score."""
    names = tuple(model.get("feature_names") or SCORER_FEATURES)
    scored = predict(vectorise_records(calls, names), model).drop("x")
    return scored.withColumn("prob", F.greatest(F.coalesce("prob", F.lit(0.0)), F.col("scorer_prob")))


def score_filter(scored: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Calls at or above the threshold, and counters of the dropped ones."""
    kept = scored.where(F.col("scorer_prob") >= float(threshold))
    return kept, drop_counters(scored.where(F.col("scorer_prob") < float(threshold)), "scorer")


def labelled_vectors(records: DataFrame, tp_ids: DataFrame, fp_ids: DataFrame, names=SCORER_FEATURES) -> DataFrame:
    """Rows (id, x, y) of the records that are labelled one way or the other."""
    return vectorise_records(label_calls(records, tp_ids, fp_ids), names).select(
        F.col("call_id").alias("id"), "x", F.col("label").alias("y"))
