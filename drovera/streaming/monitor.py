"""Live herd monitor: one keyframe row in, scored tracks out, state per flight."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..functions.motion import feature_vectors
from ..operators.tracks import FEATURES
from ..settings import AnomalySettings

KEYFRAME_ROW = (
    "flight_id BIGINT, frame_id BIGINT, kf_seq BIGINT, ts_us BIGINT, h ARRAY<DOUBLE>, "
    "tracks ARRAY<STRUCT<track_id: BIGINT, cx: DOUBLE, cy: DOUBLE>>"
)
SCORED_ROW = (
    "flight_id BIGINT, frame_id BIGINT, kf_seq BIGINT, ts_us BIGINT, track_id BIGINT, "
    "is_visible BOOLEAN, eligible BOOLEAN, ae_smooth DOUBLE, soc_smooth DOUBLE, "
    "ae_up BOOLEAN, soc_up BOOLEAN, confirmed BOOLEAN, state STRING"
)

KEYFRAME_COLS = ("flight_id", "frame_id", "kf_seq", "ts_us", "h", "tracks")
SCORED_COLS = (
    "flight_id", "frame_id", "kf_seq", "ts_us", "track_id", "is_visible", "eligible", "ae_smooth",
    "soc_smooth", "ae_up", "soc_up", "confirmed", "state",
)

Predict = Callable[[np.ndarray], np.ndarray]

#: Scored rows that a task hands on together, and sequences that the model is given together.
_OUT_ROWS, _BATCH = 100_000, 16_384
_NOTHING = pd.DataFrame(columns=list(SCORED_COLS))


@dataclass
class _Herd:
    """One entry per animal in every array, in order of its id; histories end at their last place."""

    length: int
    window: int
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mean: np.ndarray | None = None
    var: np.ndarray | None = None
    updates: int = 0

    def __post_init__(self) -> None:
        self.centre = np.zeros((0, 2))
        self.vectors = np.zeros((0, self.length, len(FEATURES)), np.float32)
        self.ae, self.soc = np.zeros((0, self.window)), np.zeros((0, self.window))
        # keyframes of the last sighting and the last vector; how many vectors and scores are held
        self.seen, self.upto, self.have, self.scored, self.flagged_for = (np.zeros(0, np.int64) for _ in range(5))

    _ARRAYS = ("ids", "centre", "vectors", "ae", "soc", "seen", "upto", "have", "scored", "flagged_for")

    def drop(self, rows: np.ndarray) -> None:
        for name in self._ARRAYS:
            setattr(self, name, getattr(self, name)[~rows])

    def admit(self, ids: np.ndarray) -> None:
        """Animals not known yet, without a history."""
        fresh = np.setdiff1d(ids, self.ids)
        if not len(fresh):
            return
        order = np.argsort(np.concatenate([self.ids, fresh]), kind="stable")
        for name in self._ARRAYS:
            own = getattr(self, name)
            empty = fresh if name == "ids" else np.zeros((len(fresh), *own.shape[1:]), own.dtype)
            setattr(self, name, np.concatenate([own, empty])[order])

    def add(self, vectors: np.ndarray, kf_seq: int) -> None:
        """A keyframe number that never arrived breaks the history, as an absence does."""
        broken = (self.have > 0) & (self.upto != kf_seq - 1)
        for name in ("have", "scored", "flagged_for", "ae", "soc"):
            getattr(self, name)[broken] = 0
        self.vectors[:, :-1] = self.vectors[:, 1:]
        self.vectors[:, -1] = vectors
        self.have = np.minimum(self.have + 1, self.length)
        self.upto[:] = kf_seq


def _warp(p: np.ndarray, h) -> np.ndarray:
    """Points (n, 2) under a homography, none being the identity."""
    if h is None or len(h) == 0:
        return p
    m = np.asarray(h, dtype=float).reshape(3, 3)
    x, y, w = m @ np.column_stack([p, np.ones(len(p))]).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w[:, None] != 0, np.column_stack([x / w, y / w]), 0.0)


class _Monitor(StatefulProcessor):
    def __init__(self, settings: AnomalySettings, make_predict_fn: Callable[[], Predict] | None,
                 ae_mean: float, ae_std: float, size: float):
        self.s = settings
        self.make_predict_fn = make_predict_fn
        self.ae_mean, self.ae_std, self.size = ae_mean, ae_std, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("herd", T.StructType([T.StructField("b", T.BinaryType())]))
        self.predict = self.make_predict_fn() if self.make_predict_fn else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("kf_seq")
        herd = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else self.empty()
        held, size = [], 0
        for kf in pdf.itertuples(index=False):
            held.append(self.step(herd, kf))
            size += len(held[-1])
            if size > _OUT_ROWS:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        self.state.update((pickle.dumps(herd),))
        yield pd.concat(held, ignore_index=True) if held else _NOTHING

    def empty(self) -> _Herd:
        return _Herd(self.s.sequence_length, self.s.smoothing_window)

    def step(self, herd: _Herd, kf) -> pd.DataFrame:
        """Scored rows of one keyframe, in order of track id."""
        seen = self._observe(herd, kf)
        if not len(herd.ids):
            return _NOTHING
        self._update_statistics(herd)
        about = {c: np.full(len(herd.ids), getattr(kf, c)) for c in ("flight_id", "frame_id", "kf_seq", "ts_us")}
        return pd.DataFrame({
            **about, "track_id": herd.ids, "is_visible": np.isin(herd.ids, seen), **self._score(herd),
        })[list(SCORED_COLS)]

    def _observe(self, herd: _Herd, kf) -> np.ndarray:
        """Append this keyframe's vectors; absent animals repeat theirs until they expire. Ids seen."""
        kf_seq = int(kf.kf_seq)
        given = [np.zeros(0) if v is None else np.asarray(v) for v in (kf.ids, kf.cx, kf.cy)]
        ids, first = np.unique(given[0].astype(np.int64), return_index=True)
        pos = np.column_stack([v.astype(float)[first] for v in given[1:]])
        herd.drop(kf_seq - herd.seen - np.isin(herd.ids, ids) > self.s.max_age)
        known = np.isin(ids, herd.ids)
        vel = np.zeros((len(ids), 2))
        vel[known] = pos[known] - _warp(herd.centre[np.searchsorted(herd.ids, ids[known])], kf.h)
        herd.admit(ids)
        latest = herd.vectors[:, -1].copy()
        if len(ids):
            at = np.searchsorted(herd.ids, ids)
            latest[at] = feature_vectors(pos, vel, self.s.knn_k, self.size)
            herd.centre[at], herd.seen[at] = pos, kf_seq
        herd.add(latest, kf_seq)
        return ids

    def _update_statistics(self, herd: _Herd) -> None:
        if not self.s.use_social or len(herd.ids) < self.s.min_herd:
            return
        latest = herd.vectors[:, -1].astype(float)
        mean, var = latest.mean(axis=0), latest.var(axis=0) + C.VARIANCE_FLOOR
        if herd.updates:
            keep = 1.0 - self.s.ema_alpha
            mean = keep * herd.mean + self.s.ema_alpha * mean
            var = keep * herd.var + self.s.ema_alpha * var
        herd.mean, herd.var, herd.updates = mean, var, herd.updates + 1

    def _score(self, herd: _Herd) -> dict[str, np.ndarray]:
        full = np.flatnonzero(herd.have >= self.s.sequence_length)
        ae, soc = np.zeros(len(full)), np.zeros(len(full))
        if self.s.use_ae and self.predict:
            for i in range(0, len(full), _BATCH):
                own = full[i : i + _BATCH]
                ae[i : i + _BATCH] = (self.predict(herd.vectors[own]) - self.ae_mean) / self.ae_std
        if self.s.use_social and herd.updates and herd.updates >= self.s.min_updates:
            soc = np.sqrt(((herd.vectors[full, -1] - herd.mean) ** 2 / herd.var).sum(axis=1))
        herd.scored[full] = np.minimum(herd.scored[full] + 1, self.s.smoothing_window)
        smooth = []
        for history, value in ((herd.ae, ae), (herd.soc, soc)):
            history[full, :-1] = history[full, 1:]
            history[full, -1] = value
            smooth.append(history[full].sum(axis=1) / herd.scored[full])
        ae_up = self.s.use_ae & (smooth[0] > self.s.ae_threshold)
        soc_up = self.s.use_social & (smooth[1] > self.s.social_threshold)
        flagged = (ae_up & soc_up) if self.s.require_both else (ae_up | soc_up)
        herd.flagged_for[full] = np.where(flagged, herd.flagged_for[full] + 1, 0)
        sure = flagged & (herd.flagged_for[full] >= self.s.min_duration)
        kind = np.where(ae_up & soc_up, "both", np.where(ae_up, "ae", "soc")).astype(object)
        state = np.where(ae_up | soc_up, np.where(sure, "confirmed_", "elevated_").astype(object) + kind, "ok")
        n = len(herd.ids)

        def spread(value: np.ndarray, none, dtype) -> np.ndarray:
            out = np.full(n, none, dtype)
            out[full] = value
            return out

        return {
            "eligible": spread(True, False, bool),
            **{c: spread(v, None, object) for c, v in zip(("ae_smooth", "soc_smooth"), smooth)},
            "ae_up": spread(ae_up, False, bool), "soc_up": spread(soc_up, False, bool),
            "confirmed": spread(sure, False, bool), "state": spread(state, "unscored", object),
        }

    def close(self) -> None:
        pass


def track_monitor(
    keyframes: DataFrame,
    *,
    settings: AnomalySettings = AnomalySettings(),
    make_predict_fn: Callable[[], Predict] | None = None,
    ae_mean: float = 0.0,
    ae_std: float = 1.0,
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
) -> DataFrame:
    """Streaming form of the whole scoring chain (features, herd statistics, states).

    A live flight delivers a few keyframes per second with at most a few hundred tracks each, so
    its state is a few hundred short histories; flights spread over the cluster. A task holds the
    histories as arrays, of a micro-batch a flight's positions (24 bytes a track) and at most some
    ``_OUT_ROWS`` scored rows beyond one keyframe; neighbours are searched in a tree where a keyframe
    has many tracks.
    """
    processor = _Monitor(settings, make_predict_fn, ae_mean, ae_std, float(max(width, height)))
    # arrays of numbers reach Python as such, structs as one object each
    parts = {"ids": "track_id", "cx": "cx", "cy": "cy"}
    rows = keyframes.select(
        *KEYFRAME_COLS[:-1], *[F.col("tracks")[c].alias(n) for n, c in parts.items()]
    )
    return rows.groupBy("flight_id").transformWithStateInPandas(
        processor, SCORED_ROW, "Append", "None"
    )
