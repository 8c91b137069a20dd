"""Checkpoints in zip form: the same arrays as those of an .npz, and nothing else is let in."""

import io
import os
import pickle
import sys
import types
import zipfile
from collections import OrderedDict

import numpy as np
import pytest
from fresh_weights import init_encoder, init_scorer

from riftscan import files
from riftscan.models import archives as ar
from riftscan.models import encoder as en
from riftscan.models import scorer as sc


class Stored:
    """A tensor as a training framework's pickle holds it."""

    def __init__(self, key, array, kind="FloatStorage", order="C"):
        self.key, self.array, self.kind = key, array, kind
        self.stride = tuple(s // array.itemsize for s in np.array(array, order=order).strides)
        self.raw = np.array(array, order=order).tobytes(order="A")

    def __reduce__(self):
        return sys.modules["torch._utils"]._rebuild_tensor_v2, (Storage(self), 0, self.array.shape, self.stride, False, OrderedDict())


class Storage:
    def __init__(self, tensor):
        self.tensor = tensor


@pytest.fixture
def framework(monkeypatch):
    top, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")

    def _rebuild_tensor_v2(*_):
        raise AssertionError

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    for name in ar.STORAGES:
        setattr(top, name, type(name, (), {"__module__": "torch"}))
    monkeypatch.setitem(sys.modules, "torch", top)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)
    return top


def archive(payload, torch):
    out, held = io.BytesIO(), {}

    class Pickler(pickle.Pickler):
        def persistent_id(self, obj):
            if isinstance(obj, Storage):
                held[obj.tensor.key] = obj.tensor.raw
                return "storage", getattr(torch, obj.tensor.kind), obj.tensor.key, "cpu", obj.tensor.array.size

    pickled = io.BytesIO()
    Pickler(pickled, 2).dump(payload)
    with zipfile.ZipFile(out, "w") as zipped:
        zipped.writestr("run/data.pkl", pickled.getvalue())
        zipped.writestr("run/byteorder", "little")
        for key, raw in held.items():
            zipped.writestr(f"run/data/{key}", raw)
    return out.getvalue()


def test_arrays_equal_those_of_an_npz(spark, tmp_path, framework):
    weights = init_encoder(6, 4, (5,), 1)
    state = OrderedDict((f"encoder.{k}", v.astype("<f4")) for k, v in {
        "0.weight": weights["h0.w"], "0.bias": weights["h0.b"], "1.weight": weights["h0.gain"] + 1, "1.bias": weights["h0.shift"],
        "4.weight": weights["out.w"], "4.bias": weights["out.b"] + 2}.items())
    tensors = OrderedDict((k, Stored(str(i), v, order="F" if v.ndim == 2 else "C")) for i, (k, v) in enumerate(state.items()))
    payload = {"model_state_dict": tensors, "model_config": {"input_dim": 6, "hidden_dims": [5]}, "mean": np.arange(3.0), "best": np.float64(0.5)}
    one, two = f"file:{tmp_path}/deep/enc.pt", str(tmp_path / "enc.npz")
    files.write_bytes(one, archive(payload, framework))
    en.save_weights(dict(state), two)
    a, b = en.load_encoder(one), en.load_encoder(two)
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)
    info = en.load_weights(one)[1]
    assert info["model_config"]["hidden_dims"] == [5] and info["best"] == 0.5 and info["mean"].tolist() == [0, 1, 2]
    assert not [n for n in os.listdir(tmp_path / "deep") if "._" in n]


def test_scorer_and_number_formats(spark, tmp_path, framework):
    weights = init_scorer((4, 5), 7, 2)
    state, at = {}, 0
    for i, at in enumerate((0, 4)):
        for new, old in (("weight", "w"), ("bias", "b")):
            state[f"net.{at}.{new}"] = weights[f"c{i}.{old}"]
        for new, old in (("weight", "gain"), ("bias", "shift"), ("running_mean", "mean"), ("running_var", "var")):
            state[f"net.{at + 1}.{new}"] = weights[f"c{i}.{old}"]
    for i, old in enumerate((1, 4)):
        for field, short in (("weight", "w"), ("bias", "b")):
            state[f"head.{old}.{field}"] = weights[f"d{i}.{short}"]
    tensors = {k: Stored(str(i), np.asarray(v, "<f8"), "DoubleStorage") for i, (k, v) in enumerate(state.items())}
    path = str(tmp_path / "scorer.pt")
    files.write_bytes(path, archive({"model_type": "cnn_scorer_v1", "state_dict": tensors, "threshold": 0.4, "feature_names": ["a"]}, framework))
    model = sc.load_scorer(path)
    x = np.random.default_rng(1).normal(size=(2, 42))
    assert model["threshold"] == 0.4 and np.allclose(sc.scorer_forward(model["weights"], x), sc.scorer_forward(weights, x))
    half = (np.array([1.5, -2.0], "<f4").view("<u4") >> 16).astype("<u2")
    got = ar.load_archive(archive({"a": Stored("0", half, "BFloat16Storage"), "b": Stored("1", np.array([[1, 2]], "<i8"), "LongStorage"),
                                   "c": Stored("2", np.array([True]), "BoolStorage")}, framework))
    assert got["a"].tolist() == [1.5, -2.0] and got["b"].tolist() == [[1, 2]] and got["c"].tolist() == [True]


def test_what_is_refused(framework):
    for thing in (os.system, print, io.BytesIO, pickle.Unpickler):
        with pytest.raises(ar.RefusedName):
            ar.load_archive(archive({"state_dict": thing}, framework))
    reaching = Stored("0", np.zeros(4, "<f4"))
    reaching.stride = (9,)
    with pytest.raises(pickle.UnpicklingError, match="beyond"):
        ar.load_archive(archive({"x": reaching}, framework))
    with pytest.raises(pickle.UnpicklingError):
        ar.load_archive(archive({"x": np.array([print], object)}, framework))
    assert not ar.is_archive(b"nothing") and ar.is_archive(archive({}, framework))
    with pytest.raises(ValueError):
        ar.split_payload({"epoch": 3})
