"""Numpy kernels: forward passes, weights, thresholds."""

import numpy as np
import pytest
from fresh_weights import init_encoder, init_scorer

from riftscan.models import encoder as en
from riftscan.models import layers as ly
from riftscan.models import scorer as sc
from riftscan.operators import features as ft
from riftscan.plans import fixtures as fx


def test_erf():
    import math
    x = np.linspace(-7, 7, 2001)
    assert np.abs(ly.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12


def test_scorer_state_import_and_forward():
    weights = init_scorer((4, 5, 6), 7, 2)
    rng = np.random.default_rng(4)
    for key in weights:
        if key.endswith((".mean", ".shift")):
            weights[key] = rng.normal(size=weights[key].shape)
    state, legacy = {}, {}
    for i, at in enumerate((0, 4, 8)):
        for new, old in (("weight", "w"), ("bias", "b")):
            state[f"backbone.net.{at}.{new}"] = legacy[f"net.{at}.{new}"] = weights[f"c{i}.{old}"]
        for new, old in (("weight", "gain"), ("bias", "shift"), ("running_mean", "mean"), ("running_var", "var")):
            state[f"backbone.net.{at + 1}.{new}"] = legacy[f"net.{at + 1}.{new}"] = weights[f"c{i}.{old}"]
    for i, (new, old) in enumerate(((0, 1), (3, 4))):
        for field, short in (("weight", "w"), ("bias", "b")):
            state[f"head.{new}.{field}"] = legacy[f"head.{old}.{field}"] = weights[f"d{i}.{short}"]
    x = rng.normal(size=(3, 42))
    wanted = sc.scorer_forward(weights, x)
    for source in (state, legacy):
        assert np.allclose(sc.scorer_forward(sc.import_state(source), x), wanted)
    # The same pass, one window at a time.
    h = x[0][None, :]
    for i in range(3):
        padded = np.pad(h, ((0, 0), (1, 1)))
        conv = np.array([[(weights[f"c{i}.w"][o] * padded[:, p:p + 3]).sum() + weights[f"c{i}.b"][o] for p in range(h.shape[1])] for o in range(len(weights[f"c{i}.b"]))])
        h = np.maximum(0, (conv - weights[f"c{i}.mean"][:, None]) / np.sqrt(weights[f"c{i}.var"][:, None] + 1e-5) * weights[f"c{i}.gain"][:, None] + weights[f"c{i}.shift"][:, None])
        if i < 2:
            h = np.array([[max(r[2 * j], r[2 * j + 1]) for j in range(len(r) // 2)] for r in h])
    pooled = np.concatenate([h.mean(axis=1), h.max(axis=1)])
    hidden = np.maximum(0, weights["d0.w"] @ pooled + weights["d0.b"])
    assert (weights["d1.w"] @ hidden + weights["d1.b"])[0] == pytest.approx(wanted[0])


def test_encoder_import_save_and_embed(spark, sf_dir, tmp_path):
    weights = init_encoder(27, 16, (12, 10), 7)
    state = {}
    for i, at in enumerate((0, 4)):
        state |= {f"encoder.encoder.{at}.weight": weights[f"h{i}.w"], f"encoder.encoder.{at}.bias": weights[f"h{i}.b"],
                  f"encoder.encoder.{at + 1}.weight": weights[f"h{i}.gain"], f"encoder.encoder.{at + 1}.bias": weights[f"h{i}.shift"]}
    state |= {"encoder.encoder.7.weight": weights["out.w"], "encoder.encoder.7.bias": weights["out.b"]}
    assert en.encoder_shape(en.import_state(state)) == (27, [12, 10], 16)
    path = str(tmp_path / "enc.npz")
    en.save_weights(state, path, {"note": 1})
    loaded = en.load_encoder(path)
    df = ft.node_features(fx.sig(spark, sf_dir))
    rows = en.embed(df, loaded).select("feat", "emb").limit(50).collect()
    raw = en.encoder_forward(weights, np.array([r.feat for r in rows]))
    assert np.allclose(np.array([r.emb for r in rows]), raw / np.linalg.norm(raw, axis=1, keepdims=True))
    plain = en.embed(df).select("feat", "emb").first()
    assert np.allclose(plain.emb, np.array(plain.feat) / np.linalg.norm(plain.feat))


def test_threshold_precedence():
    model = {"threshold": 0.4, "platform_thresholds": {"ont": 0.7}}
    assert sc.resolve_threshold(model, "ONT", 0.1) == (0.1, "cli_override")
    assert sc.resolve_threshold(model, "ONT") == (0.7, "platform_threshold:ont")
    assert sc.resolve_threshold(model, "ccs") == (0.4, "scorer_payload")
    assert sc.resolve_threshold({}, None) == (0.5, "default")


def test_record_vectors(spark):
    df = spark.createDataFrame([("a", "real", {"log_span": 2.0}), ("sim_7", None, {"length_cv": None}), ("b", " SIM ", None)],
                               "call_id string, domain string, score_features map<string,double>")
    rows = {r.call_id: r.x for r in sc.vectorise_records(df, ("log_span", "length_cv", "domain_real", "domain_sim")).collect()}
    assert rows == {"a": [2.0, 0.0, 1.0, 0.0], "sim_7": [0.0, 0.0, 0.0, 1.0], "b": [0.0, 0.0, 0.0, 1.0]}
