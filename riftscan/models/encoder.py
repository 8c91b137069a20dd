"""Signature encoder: feature vectors to unit-length embeddings."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import read_bytes, write_bytes
from ..operators.features import l2_normalise
from .archives import is_archive, load_archive, split_payload
from .layers import gelu

_NORM_EPS = 1e-5


def encoder_shape(weights: dict) -> tuple[int, list[int], int]:
    """(input, hidden, embedding) sizes, read off the weights."""
    depth = sum(1 for k in weights if k.startswith("h") and k.endswith(".w"))
    hidden = [weights[f"h{i}.w"].shape[0] for i in range(depth)]
    first = weights["h0.w"] if depth else weights["out.w"]
    return first.shape[1], hidden, weights["out.w"].shape[0]


def encoder_forward(weights: dict, x: np.ndarray) -> np.ndarray:
    """Raw embeddings of a batch: linear, layer norm and GELU per hidden layer, then linear."""
    for i in range(len(encoder_shape(weights)[1])):
        x = x @ weights[f"h{i}.w"].T + weights[f"h{i}.b"]
        centred = x - x.mean(axis=1, keepdims=True)
        x = centred / np.sqrt((centred * centred).mean(axis=1, keepdims=True) + _NORM_EPS)
        x = gelu(x * weights[f"h{i}.gain"] + weights[f"h{i}.shift"])
    return x @ weights["out.w"].T + weights["out.b"]


def import_state(state: dict) -> dict:
    """Weights from a checkpoint's named arrays.

    Checkpoints number the modules of one sequence: linear layers have two-dimensional weights, each but
    the last is followed by its norm. Names may carry one or more ``encoder.`` prefixes.
    """
    named = {}
    for key, value in state.items():
        position, _, field = key.removeprefix("encoder.").removeprefix("encoder.").partition(".")
        if position.isdigit():
            named.setdefault(int(position), {})[field] = np.asarray(value, dtype=np.float64)
    modules = [named[p] for p in sorted(named)]
    linear = [m for m in modules if m["weight"].ndim == 2]
    norms = [m for m in modules if m["weight"].ndim == 1]
    if not linear:
        raise ValueError("no encoder weights in the checkpoint")
    weights = {}
    for i, (layer, norm) in enumerate(zip(linear[:-1], norms)):
        weights |= {f"h{i}.w": layer["weight"], f"h{i}.b": layer["bias"], f"h{i}.gain": norm["weight"], f"h{i}.shift": norm["bias"]}
    return weights | {"out.w": linear[-1]["weight"], "out.b": linear[-1]["bias"]}


def save_weights(weights: dict, path: str, info: dict | None = None) -> None:
    """Write weights and a JSON description as one .npz file."""
    buffer = io.BytesIO()
    np.savez(buffer, __info__=np.array(json.dumps(info or {}, sort_keys=True)), **weights)
    write_bytes(path, buffer.getvalue())


def load_weights(path: str) -> tuple[dict, dict]:
    """Named arrays and the description of a checkpoint: .npz, or the zip form of training frameworks."""
    data = read_bytes(path)
    if is_archive(data):
        return split_payload(load_archive(data))
    with np.load(io.BytesIO(data), allow_pickle=False) as stored:
        weights = {k: stored[k] for k in stored.files if k != "__info__"}
        info = json.loads(str(stored["__info__"])) if "__info__" in stored.files else {}
    return weights, info


def load_encoder(path: str) -> dict:
    weights, _ = load_weights(path)
    return weights if "out.w" in weights else import_state(weights)


def list_column(matrix: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(len(column), -1)


def embed(df: DataFrame, weights: dict | None = None, vector: str = "feat", out: str = "emb") -> DataFrame:
    """Add unit-length embeddings. Without weights the feature vector itself is the embedding.

    Weights go to the executors once, as a broadcast; a few hundred thousand numbers at most.
    """
    if weights is None:
        return df.withColumn(out, l2_normalise(F.col(vector)))
    shared = df.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = encoder_forward(shared.value, matrix_of(batch.column(at)))
            norms = np.maximum(np.sqrt((raw * raw).sum(axis=1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(raw / norms)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select("sid", "emb").write.mode("overwrite").parquet(path)
