"""Point transforms and distances as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def perspective_apply(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Homogeneous 3x3 transform (row major array) of a point; a null matrix is the identity."""

    def at(i: int) -> Column:
        return F.get(h, F.lit(i))

    d = at(6) * x + at(7) * y + at(8)
    px = F.when(d == 0, F.lit(0.0)).otherwise((at(0) * x + at(1) * y + at(2)) / d)
    py = F.when(d == 0, F.lit(0.0)).otherwise((at(3) * x + at(4) * y + at(5)) / d)
    return F.when(h.isNull(), x).otherwise(px), F.when(h.isNull(), y).otherwise(py)


def standardize(
    cols: Sequence[str], mean: Sequence[float] | None, std: Sequence[float] | None
) -> dict[str, Column]:
    """(x - mean) / std per column; without a mean the columns pass through."""
    if mean is None or std is None:
        return {c: F.col(c) for c in cols}
    return {
        c: (F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(cols, mean, std)
    }


def z_score(col: str, mean: float = 0.0, std: float = 1.0) -> Column:
    return (F.col(col) - F.lit(float(mean))) / F.lit(float(std))


def diag_mahalanobis(
    values: Sequence[Column], means: Sequence[Column], variances: Sequence[Column]
) -> Column:
    """Square root of the sum of squared deviations over the variances."""
    total: Column | None = None
    for x, m, v in zip(values, means, variances):
        term = (x - m) * (x - m) / v
        total = term if total is None else total + term
    return F.sqrt(total)


#: Points from which neighbours are searched in a tree, and positions in a leaf of it.
TREE_FROM, LEAF = 512, 64


def _leaves(at: np.ndarray, size: int) -> list[np.ndarray]:
    """Points in groups of at most ``size``, halved at the median of the longer side."""
    out, left = [], [np.arange(len(at))]
    while left:
        own = left.pop()
        if len(own) <= size:
            out.append(own)
            continue
        side = int(np.argmax(np.ptp(at[own], axis=0)))
        own = own[np.argpartition(at[own, side], len(own) // 2)]
        left += [own[: len(own) // 2], own[len(own) // 2 :]]
    return out


def _nearest_in_tree(pos: np.ndarray, k: int) -> np.ndarray:
    """As ``nearest``, in memory proportional to the number of points.

    The search is per distinct position, for its k + 1 nearest; of the points at one position only
    the k + 1 first can be among them. A leaf meets the leaves whose boxes lie no farther than the
    largest (k + 1)-th distance inside it.
    """
    n = len(pos)
    order = np.lexsort((pos[:, 1], pos[:, 0]))  # stable, so the smaller index first
    new = np.r_[True, (np.diff(pos[order], axis=0) != 0).any(axis=1)]
    spot, start = np.cumsum(new) - 1, np.flatnonzero(new)
    held = np.minimum(np.diff(np.r_[start, n]), k + 1)
    at = pos[order[start]]
    leaves = _leaves(at, max(LEAF, 4 * (k + 1)))
    low = np.array([at[x].min(axis=0) for x in leaves])
    high = np.array([at[x].max(axis=0) for x in leaves])

    def members(of: np.ndarray) -> np.ndarray:
        shift = np.arange(held[of].sum()) - np.repeat(np.cumsum(held[of]) - held[of], held[of])
        return order[np.repeat(start[of], held[of]) + shift]

    guests = [members(x) for x in leaves]

    def apart(here: np.ndarray, there: np.ndarray) -> np.ndarray:
        dx, dy = at[here, None, 0] - pos[there, 0], at[here, None, 1] - pos[there, 1]
        return dx * dx + dy * dy

    lists = np.empty((len(at), k + 1), np.int64)
    for i, own in enumerate(leaves):
        if len(guests[i]) > k:
            reach = float(np.partition(apart(own, guests[i]), k, axis=1)[:, k].max())
            gap = np.maximum(np.maximum(low - high[i], low[i] - high), 0.0)
            met = np.flatnonzero((gap * gap).sum(axis=1) <= reach * (1 + 1e-9))
        else:
            met = np.arange(len(leaves))
        others = np.concatenate([guests[j] for j in met])
        d2 = apart(own, others)
        row, col = np.nonzero(d2 <= np.partition(d2, k, axis=1)[:, k : k + 1])
        by = np.lexsort((others[col], d2[row, col], row))
        row, col = row[by], col[by]
        first = np.arange(len(row)) - np.searchsorted(row, row) <= k
        lists[own] = others[col[first]].reshape(len(own), k + 1)
    found = np.empty((n, k + 1), np.int64)
    found[order] = lists[spot]
    keep = found != np.arange(n)[:, None]
    keep[keep.all(axis=1), k] = False
    return np.sort(found[keep].reshape(n, k), axis=1)


def nearest(pos: np.ndarray, k: int) -> np.ndarray:
    """Indices (n, k) of the k nearest other points; distance ties go to the smaller index."""
    if len(pos) > TREE_FROM:
        return _nearest_in_tree(pos, k)
    d2 = ((pos[:, None, :] - pos[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    limit = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    within = d2 <= limit
    tied = np.nonzero(within.sum(axis=1) > k)[0]
    for i in tied:
        within[i] = False
        within[i, np.argsort(d2[i], kind="stable")[:k]] = True
    return np.nonzero(within)[1].reshape(len(pos), k)


def feature_vectors(pos: np.ndarray, vel: np.ndarray, k: int, size: float) -> np.ndarray:
    """Nine float32 features per track of one keyframe, from positions and velocities (n, 2).

    Own velocity, velocity relative to the mean of the min(k, n - 1) nearest tracks, speed and its
    offset, position relative to their centroid, mean distance to them; all divided by ``size``.
    """
    n = len(pos)
    speed = np.sqrt((vel ** 2).sum(axis=1))
    at, v, s, far = pos.copy(), vel.copy(), speed.copy(), np.zeros(n)
    # a position that is not a number, or too large to tell places apart, has no neighbours
    known = np.flatnonzero((np.abs(pos) <= 2.0 ** 52).all(axis=1))
    k = min(k, len(known) - 1)
    if k > 0:
        p, near = pos[known], nearest(pos[known], k)
        at[known], v[known], s[known] = p[near].mean(axis=1), vel[known][near].mean(axis=1), speed[known][near].mean(axis=1)
        far[known] = np.sqrt(((p[near] - p[:, None, :]) ** 2).sum(axis=2)).mean(axis=1)
    offsets = [np.where(np.isin(np.arange(n), known), x, 0.0) for x in (*(vel - v).T, speed - s, *(pos - at).T)]
    cols = [vel[:, 0], vel[:, 1], *offsets[:2], speed, *offsets[2:], far]
    return (np.column_stack(cols) / size).astype(np.float32)
