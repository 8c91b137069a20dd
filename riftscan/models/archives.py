"""Checkpoints in the zip form that training frameworks write: named arrays and plain values, nothing that runs.

Such a file is a pickle of the payload (``data.pkl``) beside one raw file for each storage. The pickle is read by an
unpickler that knows a short list of names, all of which only build containers and arrays; any other name is refused
before it is looked up.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections import OrderedDict
from collections.abc import Callable

import numpy as np

#: Names of storages and their number formats.
STORAGES = {
    "DoubleStorage": "<f8", "FloatStorage": "<f4", "HalfStorage": "<f2", "BFloat16Storage": "bfloat16", "LongStorage": "<i8",
    "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?",
}


class RefusedName(pickle.UnpicklingError):
    """The payload names something that a checkpoint of arrays doesn't need."""


def _tensor(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_: object) -> np.ndarray:
    """A view of a storage, checked against its end, as an array of its own."""
    last = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) if all(size) else offset - 1
    if offset < 0 or any(s < 0 for s in stride) or last >= len(storage):
        raise pickle.UnpicklingError("a tensor reaches beyond its storage")
    strides = tuple(s * storage.itemsize for s in stride)
    return np.lib.stride_tricks.as_strided(storage[offset:], size, strides).copy()


def _parameter(data: np.ndarray, *_: object) -> np.ndarray:
    return data


def _encoded(text: str, encoding: str) -> bytes:
    if encoding != "latin1":
        raise RefusedName(encoding)
    return text.encode("latin1")


def _empty_array(*_: object) -> np.ndarray:
    return np.ndarray((0,), "u1")


def _scalar(dtype: np.dtype, raw: bytes) -> object:
    if dtype.hasobject:
        raise RefusedName("object scalar")
    return np.frombuffer(raw, dtype)[0].item()


def _dtype(name: str, *_: object) -> np.dtype:
    found = np.dtype(name)
    if found.hasobject:
        raise RefusedName(name)
    return found


_KNOWN: dict[tuple[str, str], object] = {
    ("collections", "OrderedDict"): OrderedDict, ("torch._utils", "_rebuild_tensor_v2"): _tensor, ("torch._utils", "_rebuild_parameter"): _parameter,
    ("_codecs", "encode"): _encoded, ("numpy", "dtype"): _dtype, ("numpy", "ndarray"): np.ndarray,
    ("numpy.core.multiarray", "_reconstruct"): _empty_array, ("numpy._core.multiarray", "_reconstruct"): _empty_array,
    ("numpy.core.multiarray", "scalar"): _scalar, ("numpy._core.multiarray", "scalar"): _scalar,
    **{("torch", name): kind for name, kind in STORAGES.items()},
}


class _Reader(pickle.Unpickler):
    def __init__(self, data: bytes, storage: Callable[[str, str, int], np.ndarray]) -> None:
        super().__init__(io.BytesIO(data))
        self._storage = storage

    def find_class(self, module: str, name: str) -> object:
        try:
            return _KNOWN[module, name]
        except KeyError:
            raise RefusedName(f"{module}.{name}") from None

    def persistent_load(self, pid: tuple) -> np.ndarray:
        what, kind, key, _, count = pid
        if what != "storage":
            raise RefusedName(str(what))
        return self._storage(kind, str(key), int(count))


def is_archive(data: bytes) -> bool:
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return False
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        return any(n.endswith("/data.pkl") or n == "data.pkl" for n in held.namelist())


def load_archive(data: bytes) -> object:
    """The payload of a checkpoint, its tensors as numpy arrays."""
    with zipfile.ZipFile(io.BytesIO(data)) as held:
        pickled = next(n for n in held.namelist() if n.endswith("data.pkl"))
        top = pickled.removesuffix("data.pkl")
        if f"{top}byteorder" in held.namelist() and held.read(f"{top}byteorder").strip() != b"little":
            raise ValueError("only little-endian checkpoints can be read")

        def storage(kind: str, key: str, count: int) -> np.ndarray:
            raw = held.read(f"{top}data/{key}")
            if kind == "bfloat16":  # the upper half of a float
                return (np.frombuffer(raw, "<u2", count).astype("<u4") << 16).view("<f4")
            return np.frombuffer(raw, kind, count)

        return _Reader(held.read(pickled), storage).load()


def split_payload(payload: dict) -> tuple[dict, dict]:
    """Named arrays of the model, and everything else that the payload says."""
    for name in ("encoder_state_dict", "state_dict", "model_state_dict"):
        if name in payload:
            return dict(payload[name]), {k: v for k, v in payload.items() if k != name}
    raise ValueError("the checkpoint has no state of a model")
