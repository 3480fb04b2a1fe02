"""Health monitoring end to end: tracks in, states, events and alerts out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import motion
from ..operators import alerts, anomaly, scoring, tracks
from ..session import cut, sized
from ..settings import AnomalySettings


@dataclass(frozen=True)
class HealthResult:
    states: DataFrame  # one row per (keyframe, visible or bridged track)
    events: DataFrame  # anomalous episodes
    messages: DataFrame  # alert text per keyframe, or per frame where frames are given
    cooldown_us: int
    shown: DataFrame | None = None  # boxes, scores and states of the tracks on every frame, where frames are given

    @cached_property
    def alerts(self) -> DataFrame:
        """Rate-limited alerts; their jobs run only when they are asked for."""
        return alerts.alert_cooldown(self.messages, cooldown_us=self.cooldown_us)


def track_features(
    track_rows: DataFrame,
    keyframes: DataFrame,
    *,
    settings: AnomalySettings = AnomalySettings(),
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
) -> DataFrame:
    """Bridged feature rows from boxes or centres."""
    if "cx" not in track_rows.columns:
        track_rows = tracks.track_center(track_rows)
    v = tracks.world_velocity(track_rows, keyframes, max_age=settings.max_age)
    v = v.select("flight_id", "frame_id", "kf_seq", "track_id", "cx", "cy", "vx", "vy")
    v = cut(v)
    f = tracks.knn_features(
        v, k=settings.knn_k, width=width, height=height, extents=sized(tracks.keyframe_extents(v))
    )
    f = f.select("flight_id", "frame_id", "kf_seq", "track_id", *tracks.FEATURES)
    return tracks.bridge_gaps(f, keyframes, max_age=settings.max_age)


def score_tracks(
    bridged: DataFrame,
    *,
    settings: AnomalySettings = AnomalySettings(),
    make_predict_fn: Callable | None = None,
    ae_mean: float = 0.0,
    ae_std: float = 1.0,
) -> DataFrame:
    """Both raw scores per row: reconstruction z-score (0 where not scored) and herd distance."""
    if settings.use_social:
        herd = anomaly.herd_ema(
            cut(anomaly.herd_batch_stats(bridged)), alpha=settings.ema_alpha, min_herd=settings.min_herd
        )
        rows = anomaly.social_score(bridged, herd, min_updates=settings.min_updates)
    else:
        rows = bridged.withColumn("soc", F.lit(0.0))
    if not (settings.use_ae and make_predict_fn):
        return rows.withColumn("ae", F.lit(0.0))
    keys = ["flight_id", "track_id", "kf_seq"]
    seqs = anomaly.feature_sequence(bridged, length=settings.sequence_length)
    ae = scoring.score_sequences(
        seqs, make_predict_fn=make_predict_fn, length=settings.sequence_length, mean=ae_mean, std=ae_std
    ).select(*keys, "ae")
    return rows.join(ae, keys, "left").withColumn("ae", F.coalesce("ae", F.lit(0.0)))


def tracks_on_frames(frames: DataFrame, track_rows: DataFrame, states: DataFrame) -> DataFrame:
    """Tracks of every frame from the first to the last keyframe, with the state they are shown in.

    A keyframe shows its visible tracks. A frame between two keyframes shows the tracks of both, at
    interpolated places, with the scores and state of the earlier one. ``frames`` has ``ts_us``;
    keyframes are those that ``track_rows`` or ``states`` name. Frames without tracks are not listed.
    """
    keys, boxes, copied = ["flight_id", "frame_id"], ["x1", "y1", "x2", "y2"], ["state", "ae_smooth", "soc_smooth"]
    about = [c for c in ("confidence", "class_id") if c in track_rows.columns]
    scored = states.filter("is_visible").select("flight_id", "kf_seq", "track_id", *copied)
    seen = cut(
        track_rows.select(*keys, "kf_seq", "track_id", *boxes, *about)
        .join(scored, ["flight_id", "kf_seq", "track_id"], "left").drop("kf_seq")
    )
    key = seen.select(*keys).unionByName(states.select(*keys)).distinct().withColumn("is_keyframe", F.lit(True))
    every = cut(frames.select(*keys, "ts_us").join(key, keys, "left").withColumn("is_keyframe", F.coalesce("is_keyframe", F.lit(False))))
    between = tracks.interpolate_tracks(every, seen, boxes=boxes, copied=[*about, *copied])
    cols = [*keys, "ts_us", "track_id", *boxes, *about, *copied]
    at = seen.join(every.filter("is_keyframe").select(*keys, "ts_us"), keys)
    return at.select(*cols).unionByName(between.filter("track_id is not null").select(*cols))


def health_monitoring(
    track_rows: DataFrame,
    keyframes: DataFrame,
    *,
    settings: AnomalySettings = AnomalySettings(),
    make_predict_fn: Callable | None = None,
    ae_mean: float = 0.0,
    ae_std: float = 1.0,
    feature_mean: Sequence[float] | None = None,
    feature_std: Sequence[float] | None = None,
    cooldown_us: int = C.ALERT_COOLDOWN_US,
    width: int = C.PROCESSING_SHAPE[0],
    height: int = C.PROCESSING_SHAPE[1],
    frames: DataFrame | None = None,
) -> HealthResult:
    """The whole chain. Stages that several later ones read are cut into the checkpoint folder.

    With ``frames`` (all frames, keyframes among them) the tracks are also placed on the frames
    between keyframes, and alerts are decided on every frame; without, on keyframes.

    ``feature_mean`` and ``feature_std``, one number per feature in the order of
    ``tracks.FEATURES``, normalise features before the herd statistics and both scores see them.
    """
    keyframes = sized(keyframes)
    bridged = track_features(track_rows, keyframes, settings=settings, width=width, height=height)
    if feature_mean is not None and feature_std is not None:
        scaled = motion.standardize(tracks.FEATURES, feature_mean, feature_std)
        bridged = bridged.withColumns({c: e.cast("float") for c, e in scaled.items()})
    bridged = cut(bridged)
    scored = score_tracks(
        bridged, settings=settings, make_predict_fn=make_predict_fn, ae_mean=ae_mean, ae_std=ae_std
    )
    states = cut(
        anomaly.score_states(
            scored,
            length=settings.sequence_length,
            window=settings.smoothing_window,
            min_duration=settings.min_duration,
            ae_threshold=settings.ae_threshold,
            social_threshold=settings.social_threshold,
            use_ae=settings.use_ae,
            use_social=settings.use_social,
            require_both=settings.require_both,
        )
    )
    events = anomaly.anomaly_events(states, keyframes, min_duration=settings.min_duration)
    line = ("flight_id", "frame_id", "ts_us")
    if frames is None:
        return HealthResult(states, events, alerts.anomaly_message(states, keys=line), cooldown_us)
    shown = cut(tracks_on_frames(frames, track_rows, states))
    messages = alerts.anomaly_message(shown, keys=line, frames=frames)
    return HealthResult(states, events, messages, cooldown_us, shown)
