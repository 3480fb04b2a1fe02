"""Trajectory reconstruction scores: batched model inference inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

Predict = Callable[[np.ndarray], np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(x: np.ndarray, w: Mapping[str, np.ndarray], h: np.ndarray, c: np.ndarray):
    """One direction of one layer over (batch, time, features); gates in order in, forget, cell, out."""
    out = np.empty((x.shape[0], x.shape[1], h.shape[1]))
    for t in range(x.shape[1]):
        i, f, g, o = np.split(x[:, t] @ w["ih"].T + w["b"] + h @ w["hh"].T, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out, h


def _layer(weights: Mapping[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    return {
        "ih": weights[f"{name}.ih"], "hh": weights[f"{name}.hh"],
        "b": weights[f"{name}.b_ih"] + weights[f"{name}.b_hh"],
    }


def _count(weights: Mapping[str, np.ndarray], prefix: str) -> int:
    n = 0
    while f"{prefix}.{n}.ih" in weights:
        n += 1
    return n


def reconstruction_error(x: np.ndarray, weights: Mapping[str, np.ndarray]) -> np.ndarray:
    """Mean squared error over the velocity features of a (batch, time, 9) array.

    Encoder: bidirectional LSTM, last states of the top layer, linear, tanh. Decoder: the latent
    seeds an LSTM that runs on zero input, and a linear layer maps its outputs. Weight names are
    ``enc.<layer>.*`` / ``enc_rev.<layer>.*`` / ``dec.<layer>.*`` with ``ih hh b_ih b_hh``, and
    ``latent.w/b``, ``seed.w/b``, ``proj.w/b``.
    """
    n, steps, _ = x.shape
    seq = x.astype(np.float64)
    hidden = weights["enc.0.hh"].shape[1]
    zero = np.zeros((n, hidden))
    for k in range(_count(weights, "enc")):
        fwd, h_f = _lstm(seq, _layer(weights, f"enc.{k}"), zero, zero)
        rev, h_b = _lstm(seq[:, ::-1], _layer(weights, f"enc_rev.{k}"), zero, zero)
        seq = np.concatenate([fwd, rev[:, ::-1]], axis=2)
    z = np.tanh(np.concatenate([h_f, h_b], axis=1) @ weights["latent.w"].T + weights["latent.b"])
    layers = _count(weights, "dec")
    h0, c0 = np.split(z @ weights["seed.w"].T + weights["seed.b"], 2, axis=1)
    h0, c0 = (s.reshape(n, layers, -1) for s in (h0, c0))
    out = np.zeros((n, steps, weights["dec.0.ih"].shape[1]))
    for k in range(layers):
        out, _ = _lstm(out, _layer(weights, f"dec.{k}"), h0[:, k], c0[:, k])
    guess = out @ weights["proj.w"].T + weights["proj.b"]
    dims = guess.shape[2]
    return ((x[:, :, :dims] - guess) ** 2).mean(axis=(1, 2))


def autoencoder_from_npz(path: str) -> Callable[[], Predict]:
    """Loader for weights every executor can read at ``path``."""

    def make() -> Predict:
        with np.load(path) as f:
            weights = {k: f[k] for k in f.files}
        return lambda batch: reconstruction_error(batch, weights).astype(np.float64)

    return make


def score_sequences(
    seqs: DataFrame,
    *,
    make_predict_fn: Callable[[], Predict],
    length: int = C.SEQUENCE_LENGTH,
    dim: int = C.FEATURE_DIM,
    mean: float = 0.0,
    std: float = 1.0,
    batch_size: int = 1024,
    column: str = "sequence",
    out: str = "ae",
) -> DataFrame:
    """z-score of the model error of each (length, dim) sequence.

    ``make_predict_fn`` is called once per Python worker and its result sees Arrow batches that mix
    frames and flights, so small herds still fill a batch.
    """
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[length, dim]],
    )
    error = predict(F.flatten(F.col(column)))
    return seqs.withColumn(out, (error - F.lit(float(mean))) / F.lit(float(std)))


def mean_square_speed() -> Callable[[], Predict]:
    """A weightless scorer (mean square of the velocity features), the error of a model that always
    reconstructs rest. Useful where no trained weights exist."""

    def make() -> Predict:
        return lambda batch: (
            batch[:, :, : C.VELOCITY_DIM].astype(np.float64) ** 2
        ).mean(axis=(1, 2))

    return make
