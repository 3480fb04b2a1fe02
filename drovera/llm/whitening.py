"""Whitening of embeddings: spectra by rank-one updates, combined in a tree, refined by Rayleigh-Ritz.

Each block of rows keeps the eigenvectors and eigenvalues of its own scatter matrix and takes one
vector after the other as a centred rank-one update: the new eigenvalues are the roots of a secular
equation, entries that cannot move are deflated. Spectra of blocks are combined the same way, one
eigenpair at a time. The result is a basis; the covariance projected on it is summed over all rows
once more, and its small eigenproblem gives the components to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stage

#: Most components that come back.
COMPONENTS = 32
#: Entries become floor(SCALE * entry) + SHIFT, within CLAMP of the shift.
SCALE, SHIFT, CLAMP = 64, 1_000_000, 1 << 52
#: Rows of one block of rank-one updates, and blocks that one task combines.
BLOCK, FANOUT = 2048, 16

_EPS = np.finfo(float).eps
_LOW = 26  # bits; sums of the two halves of an entry stay exact in 64 bits


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z_j**2 / (d_j - x))`` for rising ``d``, no zero in ``z``, ``rho > 0``.

    Root i lies between ``d_i`` and ``d_{i+1}``, the last one below ``d_k + rho * |z|**2``. Returned
    as ``(origin, offset)``: the nearer end of the interval and the distance from it, which keeps
    differences between a root and any ``d_j`` exact to rounding.
    """
    k = len(d)
    w = rho * z * z
    right = np.append(d[1:], d[-1] + w.sum())
    gap = right - d
    low = np.tri(k, dtype=bool)  # pole j is at or left of root i
    middle = 1 + (w / (d - (d + gap / 2)[:, None])).sum(axis=1)
    at_left = middle >= 0
    at_left[-1] = True
    origin = np.where(at_left, d, right)
    delta = d - origin[:, None]
    ends = np.where(at_left, 0.0, -gap), np.where(at_left, gap, 0.0)
    lo, hi = ends[0].copy(), ends[1].copy()
    tau = np.where(at_left, gap / 2, -gap / 2)
    todo = np.arange(k)
    for _ in range(90):
        t = tau[todo]
        rest = delta[todo] - t[:, None]
        terms = w / rest
        slopes = terms / rest
        value = 1 + terms.sum(axis=1)
        size = 1 + np.abs(terms).sum(axis=1)
        lo[todo] = np.where(value <= 0, t, lo[todo])
        hi[todo] = np.where(value >= 0, t, hi[todo])
        near = np.abs(value) > 4 * _EPS * size
        wide = hi[todo] - lo[todo] > 4 * _EPS * np.maximum(np.abs(lo[todo]), np.abs(hi[todo]))
        on = near & wide
        if not on.any():
            break
        t, value, slopes, todo = t[on], value[on], slopes[on], todo[on]
        slope = slopes.sum(axis=1)
        left_slope = np.where(low[todo], slopes, 0).sum(axis=1)
        last = todo == k - 1
        # Poles at both ends of the interval, weighted so that value and slopes agree here.
        to_left, to_right = d[todo] - origin[todo] - t, right[todo] - origin[todo] - t
        a = (to_left + to_right) * value - to_left * to_right * slope
        b = to_left * to_right * value
        c = value - to_left * left_slope - to_right * (slope - left_slope)
        with np.errstate(all="ignore"):
            disc = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - disc) / (2 * c), 2 * b / (a + disc))
            one = value - to_left * slope
            move = np.where(last, to_left + to_left * to_left * slope / one, move)
        new = t + move
        inside = (new > lo[todo]) & (new < hi[todo])
        tau[todo] = np.where(inside, new, (lo[todo] + hi[todo]) / 2)
    # A root on a pole would lose its vector.
    tau = np.where(tau == 0, np.where(at_left, 1, -1) * np.finfo(float).tiny, tau)
    return origin, tau


@dataclass
class Spectrum:
    """``count`` vectors with their ``mean``; their scatter is ``vectors * values * vectors.T``."""

    dims: int
    count: float = 0.0
    mean: np.ndarray = field(default=None)
    values: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.mean is None:
            self.mean = np.zeros(self.dims)
            self.values, self.vectors = np.zeros(self.dims), np.eye(self.dims)

    def add(self, x: np.ndarray, copies: float = 1.0) -> None:
        """Take ``copies`` of a vector."""
        total = self.count + copies
        away = x - self.mean
        self.update(away, self.count * copies / total)
        self.mean = self.mean + away * (copies / total)
        self.count = total

    def merge(self, other: Spectrum) -> None:
        """Take all vectors of another spectrum: its eigenpairs, and the distance of the means."""
        if other.count == 0:
            return
        for value, vector in zip(other.values, other.vectors.T):
            self.update(vector, float(value))
        total = self.count + other.count
        away = other.mean - self.mean
        self.update(away, self.count * other.count / total)
        self.mean = self.mean + away * (other.count / total)
        self.count = total

    def update(self, v: np.ndarray, rho: float) -> None:
        """Spectrum of the scatter plus ``rho * v * v.T``; values stay in rising order."""
        z = v @ self.vectors
        top = max(self.values[-1], 0.0) + rho * float(z @ z)
        if rho <= 0 or top <= 0:
            return
        tol = 8 * _EPS * top
        values, vectors = self.values, self.vectors
        # Equal values: turn their vectors so that only one of them meets the update.
        close = np.diff(values) <= tol
        if close.any():
            starts = np.flatnonzero(np.r_[True, ~close])
            for a, b in zip(starts, np.r_[starts[1:], len(values)]):
                if b - a > 1 and np.any(z[a : b - 1]):
                    mirror = z[a:b].copy()
                    norm = float(np.sqrt(mirror @ mirror))
                    sign = 1.0 if mirror[-1] >= 0 else -1.0
                    mirror[-1] += sign * norm
                    scale = 2 / float(mirror @ mirror)
                    part = vectors[:, a:b]
                    part -= np.outer(part @ mirror, mirror * scale)
                    z[a : b - 1] = 0
                    z[b - 1] = -sign * norm
        moved = np.flatnonzero(rho * np.abs(z) * np.sqrt(z @ z) > tol)
        if not len(moved):
            return
        d, y = values[moved], z[moved]
        origin, tau = secular_roots(d, y, rho)
        # away[j, i] = root i - d_j, without cancellation.
        away = (origin - d[:, None]) + tau
        between = d - d[:, None]
        np.fill_diagonal(between, 1.0)
        # The vector for which the computed roots are exact keeps the new basis orthogonal.
        exact = np.sqrt(np.abs(np.prod(away / between, axis=1)) / rho) * np.where(y < 0, -1, 1)
        turn = exact[:, None] / -away
        turn /= np.sqrt((turn * turn).sum(axis=0))
        vectors[:, moved] = vectors[:, moved] @ turn
        values = values.copy()
        values[moved] = origin + tau
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], np.ascontiguousarray(vectors[:, order])


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _fold(rows: DataFrame, merge: Callable[[pd.DataFrame], dict], label: str) -> dict | None:
    """Combine rows ``(part, ...)`` in a tree of ``FANOUT`` children; the one row that is left."""
    schema, above = rows.schema, stage(rows, label)

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**merge(group.sort_values("part")), "part": key[0]}])[schema.fieldNames()]

    while True:
        high = above.agg(F.max("part")).first()[0]
        if not high:
            last = above.first()
            discard(above)
            return None if last is None else last.asDict()
        below = above
        above = stage(below.groupBy(F.floor(F.col("part") / FANOUT).alias("up")).applyInPandas(work, schema), label)
        discard(below)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector has no null, infinite or undefined entry."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    # 2**1000 is a bound no finite float passes after the clamp, and no infinite one.
    whole = raw.where("c is not null and forall(c, e -> e is not null and not isnan(e) and abs(e) < double('Infinity'))")
    return whole.selectExpr(
        "vec_id", f"transform(c, e -> cast(floor(greatest(least(e * {SCALE}D, {CLAMP}D), -{CLAMP}D)) as bigint) + {SHIFT}L) as x"
    )


@dataclass(frozen=True)
class Whitening:
    """What the fit found. ``sums`` and ``base`` are exact; ``components`` are columns."""

    n: int
    sums: list[int]
    base: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        """Mean of ``x - base``."""
        return np.array([(s - self.n * b) / self.n for s, b in zip(self.sums, self.base)])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections on the components over the roots of their eigenvalues; NaN where one is zero."""
        away = (x - np.array(self.base)).astype(float) - self.mean
        with np.errstate(all="ignore"):
            return np.where(self.values > 0, (away @ self.components) / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - sums)**2``, exact; None beyond 64 bits."""
        if not len(x):
            return []
        ends = [max(abs(self.n * int(lo) - s), abs(self.n * int(hi) - s)) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), self.sums)]
        if sum(e * e for e in ends) < 1 << 63 and self.n * int(np.abs(x).max()) < 1 << 62:
            away = self.n * x - np.array(self.sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x)
        return [e if e < 1 << 63 else None for e in exact]


def _sums(staged: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = _matrix(b, dims)
            n, high, low = n + len(x), high + (x >> _LOW).sum(axis=0), low + (x & ((1 << _LOW) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "high": [high.tolist()], "low": [low.tolist()]})

    def merge(g: pd.DataFrame) -> dict:
        return {"n": int(g["n"].sum()), "high": np.stack(g["high"].to_list()).sum(axis=0), "low": np.stack(g["low"].to_list()).sum(axis=0)}

    found = _fold(staged.mapInArrow(work, "part long, n long, high array<long>, low array<long>"), merge, "sums")
    return found["n"], [(h << _LOW) + lo for h, lo in zip(found["high"], found["low"])]


def basis(staged: DataFrame, dims: int, base: list[int]) -> np.ndarray:
    """Eigenvectors of the scatter of ``x - base`` by rank-one updates, as columns, values rising."""
    def pack(s: Spectrum) -> dict:
        return {"n": s.count, "mean": s.mean, "vals": s.values, "vecs": s.vectors.ravel()}

    def unpack(r: dict) -> Spectrum:
        return Spectrum(dims, float(r["n"]), np.array(r["mean"]), np.array(r["vals"]), np.array(r["vecs"]).reshape(dims, dims).copy())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(dims)
        for b in batches:
            if b.num_rows:
                rows, copies = np.unique(_matrix(b, dims) - np.array(base), axis=0, return_counts=True)
                for x, k in zip(rows.astype(float), copies.tolist()):
                    s.add(x, k)
        if s.count:
            row = {"part": TaskContext.get().partitionId(), **pack(s)}
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

    def merge(g: pd.DataFrame) -> dict:
        parts = [unpack(r) for r in g.to_dict("records")]
        for p in parts[1:]:
            parts[0].merge(p)
        return pack(parts[0])

    schema = "part long, n double, mean array<double>, vals array<double>, vecs array<double>"
    return unpack(_fold(staged.mapInArrow(work, schema), merge, "spectra")).vectors


def _gram(staged: DataFrame, dims: int, project: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Sum over all rows of the outer square of their projection to ``k`` numbers, and of a last 1."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y = project(_matrix(b, dims))
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        if total[-1, -1]:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "m": [total.ravel()]})

    merge = lambda g: {"m": np.stack(g["m"].to_list()).sum(axis=0)}
    found = _fold(staged.mapInArrow(work, "part long, m array<double>"), merge, "gram")
    return np.array(found["m"]).reshape(k + 1, k + 1)


def fit(staged: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Components of staged ``(vec_id, x)``; what reaches the driver is bounded by ``dims`` squared."""
    n, sums = _sums(staged, dims)
    base = [(2 * s + n) // (2 * n) for s in sums]
    start = Whitening(n, sums, base, np.ones(dims), basis(staged, dims, base), np.ones(dims))
    # Rayleigh-Ritz: the covariance in the found basis is almost diagonal; its own eigenvectors mend the rest.
    gram = _gram(staged, dims, start.whiten, dims)
    mean = gram[-1, :-1] / n
    values, turn = np.linalg.eigh(gram[:-1, :-1] / n - np.outer(mean, mean))
    trace = float(values.sum())
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    top = np.where(values[order] > dims * _EPS * max(trace, 0), values[order], 0.0)
    share = np.maximum(values[order], 0) / trace if trace > 0 else np.full(len(order), np.nan)
    return Whitening(n, sums, base, top, start.components @ turn[:, order], share)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK
) -> DataFrame:
    """One row per vector and component: ``vec_id component n deviation whitened explained identity_error``.

    Components are numbered from 1 by falling eigenvalue of the covariance of all integer vectors.
    Vectors that are null or hold null or non-finite entries are dropped, and those of another
    length than the most frequent one (of equally frequent ones the longest). Entries beyond 2**46
    in size count as that. ``whitened`` is null along components without variance, ``explained`` is
    null where nothing varies, and ``identity_error`` covers the components with variance (null if
    there are none); ``deviation`` is null beyond 64 bits. Repeated rows and null ids each count and come
    back; without vectors, or with empty ones, there are no rows. Other columns are not read.
    """
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = integer_vectors(vectors, id_col, vector_col)
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return vectors.sparkSession.createDataFrame([], out)
    dims, rows = lengths["d"], lengths["count"]
    # Updates cost far more than reading, so rows are dealt evenly to blocks first.
    staged = stage(kept.where(F.size("x") == dims).repartition(-(-rows // block)), "vectors")
    found = fit(staged, dims, components)
    live = found.values > 0
    error = None
    if live.any():
        gram = _gram(staged, dims, lambda x: found.whiten(x)[:, live], int(live.sum()))
        mean = gram[-1, :-1] / found.n
        error = float(np.abs(gram[:-1, :-1] / found.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    k = len(found.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                x = _matrix(b, dims)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                flat = found.whiten(x).ravel()
                share = np.tile(found.explained, len(x))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": b.column("vec_id").take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(flat), found.n)), "deviation": pa.array(found.deviation(x), pa.int64()).take(each),
                    "whitened": pa.array(flat, mask=np.isnan(flat)), "explained": pa.array(share, mask=np.isnan(share)),
                    "identity_error": pa.array([error] * len(flat), pa.float64()),
                })

    return staged.mapInArrow(work, out)
