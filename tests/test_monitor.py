"""The live herd monitor: neighbours of large herds, and memory that follows the number of animals."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest

from drovera.functions import motion
from drovera.operators import scoring
from drovera.settings import AnomalySettings
from drovera.streaming import monitor


def by_pairs(pos, k):
    d2 = ((pos[:, None, :] - pos[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    return np.sort(np.argsort(d2, axis=1, kind="stable")[:, :k], axis=1)


@pytest.mark.parametrize("kind", ["grid", "spread", "one place", "line", "clumps"])
def test_neighbours_of_large_herds(kind):
    rng = np.random.default_rng(3)
    n = motion.TREE_FROM + 400
    pos = {
        "grid": rng.integers(0, 20, (n, 2)).astype(float),
        "spread": rng.random((n, 2)) * 1000,
        "one place": np.zeros((n, 2)),
        "line": np.c_[np.arange(float(n)) % 97, np.zeros(n)],
        "clumps": np.r_[rng.random((n // 2, 2)), rng.random((n - n // 2, 2)) * 1e6],
    }[kind]
    for k in (1, 5, 30):
        assert (motion.nearest(pos, k) == by_pairs(pos, k)).all()


def test_memory_follows_the_number_of_animals():
    """30,000 animals in a keyframe: all pairs at once would take 14 GB."""
    rng = np.random.default_rng(4)
    n = 30_000
    m = monitor._Monitor(AnomalySettings(), scoring.mean_square_speed(), 0.0, 1.0, 1280.0)
    m.predict = m.make_predict_fn()
    herd = m.empty()
    tracemalloc.start()
    for k in range(3):
        kf = SimpleNamespace(
            flight_id=1, frame_id=k, kf_seq=k, ts_us=k, h=None, ids=np.arange(n),
            cx=rng.integers(0, 1280, n).astype(float), cy=rng.integers(0, 720, n).astype(float),
        )
        assert len(m.step(herd, kf)) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


def test_unknown_positions_have_no_neighbours():
    pos = np.array([[0.0, 0.0], [3.0, 4.0], [np.nan, 1.0], [1e300, 0.0]])
    f = motion.feature_vectors(pos, np.ones((4, 2)), 5, 1.0)
    assert f[:2, 8].tolist() == [5.0, 5.0]
    assert f[2:, 2:4].tolist() == [[0.0, 0.0]] * 2 and f[2:, 5:].tolist() == [[0.0] * 4] * 2
