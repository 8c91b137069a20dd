"""Fresh weights of both networks, at their default shapes unless told otherwise."""

import math

import numpy as np

from riftscan.operators.features import FULL_DIM

# Default shapes.
EMBED_DIM = 128
HIDDEN_DIMS = (128, 256, 256, 128)
CHANNELS = (32, 64, 64)
HIDDEN_DIM = 64


def glorot(rng: np.random.Generator, out_dim: int, in_dim: int) -> np.ndarray:
    bound = math.sqrt(6.0 / (in_dim + out_dim))
    return rng.uniform(-bound, bound, size=(out_dim, in_dim))


def init_encoder(input_dim: int = FULL_DIM, embed_dim: int = EMBED_DIM, hidden_dims=HIDDEN_DIMS, seed: int = 42) -> dict:
    """Fresh weights: layers of (w, b, gain, shift) and an output layer (w, b)."""
    rng = np.random.default_rng(seed)
    weights, previous = {}, input_dim
    for i, width in enumerate(hidden_dims):
        weights |= {f"h{i}.w": glorot(rng, width, previous), f"h{i}.b": np.zeros(width),
                    f"h{i}.gain": np.ones(width), f"h{i}.shift": np.zeros(width)}
        previous = width
    return weights | {"out.w": glorot(rng, embed_dim, previous), "out.b": np.zeros(embed_dim)}


def init_scorer(channels=CHANNELS, hidden_dim: int = HIDDEN_DIM, seed: int = 42) -> dict:
    rng = np.random.default_rng(seed)
    weights, previous = {}, 1
    for i, width in enumerate(channels):
        weights |= {f"c{i}.w": glorot(rng, width, previous * 3).reshape(width, previous, 3), f"c{i}.b": np.zeros(width),
                    f"c{i}.gain": np.ones(width), f"c{i}.shift": np.zeros(width),
                    f"c{i}.mean": np.zeros(width), f"c{i}.var": np.ones(width)}
        previous = width
    return weights | {"d0.w": glorot(rng, hidden_dim, 2 * previous), "d0.b": np.zeros(hidden_dim),
                      "d1.w": glorot(rng, 1, hidden_dim), "d1.b": np.zeros(1)}
