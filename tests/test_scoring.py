from __future__ import annotations

import math

import numpy as np
import pytest

from drovera.operators import scoring as S


def make_weights(rng, dim=9, hid=3, lat=2, out=6, layers=2):
    w = {}

    def cell(name, n_in, h):
        for k, shape in (("ih", (4 * h, n_in)), ("hh", (4 * h, h)), ("b_ih", (4 * h,)), ("b_hh", (4 * h,))):
            w[f"{name}.{k}"] = rng.normal(0, 0.5, shape)

    for i in range(layers):
        for side in ("enc", "enc_rev"):
            cell(f"{side}.{i}", dim if i == 0 else 2 * hid, hid)
        cell(f"dec.{i}", out if i == 0 else hid, hid)
    for name, shape in (("latent", (lat, 2 * hid)), ("seed", (2 * layers * hid, lat)), ("proj", (out, hid))):
        w[f"{name}.w"], w[f"{name}.b"] = rng.normal(0, 0.5, shape), rng.normal(0, 0.5, shape[0])
    return w


def scalar_lstm(seq, w, name, h, c):
    """Plain loops over one sequence."""
    n, outs = len(h), []
    sig = lambda v: 1 / (1 + math.exp(-v))
    for x in seq:
        z = [sum(w[f"{name}.ih"][g, j] * x[j] for j in range(len(x))) + sum(w[f"{name}.hh"][g, j] * h[j] for j in range(n))
             + w[f"{name}.b_ih"][g] + w[f"{name}.b_hh"][g] for g in range(4 * n)]
        c = [sig(z[n + i]) * c[i] + sig(z[i]) * math.tanh(z[2 * n + i]) for i in range(n)]
        h = [sig(z[3 * n + i]) * math.tanh(c[i]) for i in range(n)]
        outs.append(list(h))
    return outs, h


def scalar_error(x, w, hid=3, layers=2):
    seq = x.tolist()
    for i in range(layers):
        f, hf = scalar_lstm(seq, w, f"enc.{i}", [0.0] * hid, [0.0] * hid)
        b, hb = scalar_lstm(seq[::-1], w, f"enc_rev.{i}", [0.0] * hid, [0.0] * hid)
        seq = [p + q for p, q in zip(f, b[::-1])]
    z = np.tanh(w["latent.w"] @ np.array(hf + hb) + w["latent.b"])
    s = w["seed.w"] @ z + w["seed.b"]
    half = layers * hid
    out = [[0.0] * 6 for _ in x]
    for i in range(layers):
        out, _ = scalar_lstm(out, w, f"dec.{i}", s[i * hid : (i + 1) * hid].tolist(), s[half + i * hid : half + (i + 1) * hid].tolist())
    guess = np.array(out) @ w["proj.w"].T + w["proj.b"]
    return float(((x[:, :6] - guess) ** 2).mean())


def test_autoencoder_against_plain_loops(spark, tmp_path):
    rng = np.random.default_rng(0)
    w = make_weights(rng)
    path = str(tmp_path / "w.npz")
    np.savez(path, **w)
    x = rng.normal(0, 1, (7, 5, 9)).astype(np.float32)
    rows = [(i, x[i].astype(float).tolist()) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id INT, sequence ARRAY<ARRAY<FLOAT>>")
    got = S.score_sequences(df, make_predict_fn=S.autoencoder_from_npz(path), length=5, mean=0.5, std=2.0, batch_size=3)
    for r in got.collect():
        assert r.ae == pytest.approx((scalar_error(x[r.id].astype(float), w) - 0.5) / 2.0, rel=1e-6)
