"""Herd statistics, scores, states and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import motion
from ..operators import alerts, anomaly, scoring
from ..operators import tracks as T
from ..session import cut
from . import views as V
from .q_tracks import bridged, rounded
from .registry import query

_BRIDGED = V.FEATURE_SQL + V.BRIDGE_SQL.format(src="feat", out="bf")
_STATS = [f"{p}_{f}" for p in ("mean", "var") for f in T.FEATURES]
ALPHA, MIN_HERD, MIN_UPDATES = 0.3, 5, 10

_BATCH = (
    _BRIDGED
    + ", batch AS (SELECT flight_id, kf_seq, count(*) AS n_tracks, "
    + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS mean_{f}" for f in T.FEATURES)
    + ", "
    + ", ".join(f"var_pop(CAST({f} AS DOUBLE)) + 1e-8 AS var_{f}" for f in T.FEATURES)
    + " FROM bf GROUP BY 1, 2)"
)

_EMA = (
    _BATCH
    + f""", upd AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY kf_seq) AS n_updates
      FROM batch WHERE n_tracks >= {MIN_HERD}),
    ema AS (
      SELECT flight_id, kf_seq, n_updates, {', '.join(_STATS)} FROM upd WHERE n_updates = 1
      UNION ALL
      SELECT u.flight_id, u.kf_seq, u.n_updates, {', '.join(f'{1 - ALPHA} * e.{s} + {ALPHA} * u.{s}' for s in _STATS)}
      FROM ema e JOIN upd u ON u.flight_id = e.flight_id AND u.n_updates = e.n_updates + 1),
    herd AS (SELECT b.flight_id, b.kf_seq, b.n_tracks, coalesce(e.n_updates, 0) AS n_updates, {', '.join(f'e.{s}' for s in _STATS)}
      FROM batch b ASOF LEFT JOIN ema e ON e.flight_id = b.flight_id AND e.kf_seq <= b.kf_seq)"""
)


def batches(spark, d, bridged_rows: DataFrame | None = None) -> DataFrame:
    return anomaly.herd_batch_stats(bridged(spark, d) if bridged_rows is None else bridged_rows)


@query(
    "herd_batch_stats",
    f"WITH {_BATCH} SELECT flight_id, kf_seq, n_tracks, "
    + ", ".join(f"round({s}, 7) AS {s}" for s in _STATS) + " FROM batch",
)
def batch_query(spark, d) -> DataFrame:
    return batches(spark, d).select(
        "flight_id", "kf_seq", "n_tracks", *[F.round(s, 7).alias(s) for s in _STATS]
    )


@query(
    "herd_ema",
    f"WITH RECURSIVE {_EMA} SELECT flight_id, kf_seq, n_updates, "
    + ", ".join(f"round({s}, 7) AS {s}" for s in _STATS) + " FROM herd",
)
def ema_query(spark, d) -> DataFrame:
    e = anomaly.herd_ema(cut(batches(spark, d)), alpha=ALPHA, min_herd=MIN_HERD)
    return e.select("flight_id", "kf_seq", "n_updates", *[F.round(s, 7).alias(s) for s in _STATS])


@query(
    "social_score",
    f"""WITH RECURSIVE {_EMA} SELECT b.flight_id, b.kf_seq, b.track_id, b.is_visible,
      round(CASE WHEN n_updates >= {MIN_UPDATES} THEN sqrt("""
    + " + ".join(f"power(b.{f} - h.mean_{f}, 2) / h.var_{f}" for f in T.FEATURES)
    + """) ELSE 0 END, 5) AS soc FROM bf b JOIN herd h USING (flight_id, kf_seq)""",
)
def social(spark, d) -> DataFrame:
    b = cut(bridged(spark, d))
    e = anomaly.herd_ema(cut(batches(spark, d, b)), alpha=ALPHA, min_herd=MIN_HERD)
    s = anomaly.social_score(b, e, min_updates=MIN_UPDATES)
    return s.select("flight_id", "kf_seq", "track_id", "is_visible", F.round("soc", 5).alias("soc"))


_MEAN = [0.01 * i for i in range(9)]
_STD = [0.5 + 0.125 * i for i in range(9)]


@query(
    "standardize",
    f"WITH {V.FEATURE_SQL} SELECT flight_id, kf_seq, track_id, "
    + ", ".join(f"round(({f} - {m!r}::DOUBLE) / {s!r}, 6) AS {f}" for f, m, s in zip(T.FEATURES, _MEAN, _STD))
    + " FROM feat",
)
def standardized(spark, d) -> DataFrame:
    from .q_tracks import features

    f = features(spark, d)
    f = f.withColumns(motion.standardize(T.FEATURES, _MEAN, _STD))
    return f.select("flight_id", "kf_seq", "track_id", *rounded(*T.FEATURES))


@query(
    "feature_sequence",
    f"""WITH {_BRIDGED}, g AS (SELECT *, kf_seq - row_number() OVER (PARTITION BY flight_id, track_id ORDER BY kf_seq) AS seg FROM bf),
    n AS (SELECT *, row_number() OVER w AS rn, sum(CAST(vx_world AS DOUBLE)) OVER v AS sx, sum(CAST(knn_dist AS DOUBLE)) OVER v AS sd
      FROM g WINDOW w AS (PARTITION BY flight_id, track_id, seg ORDER BY kf_seq),
        v AS (PARTITION BY flight_id, track_id, seg ORDER BY kf_seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
    SELECT flight_id, kf_seq, track_id, 6::BIGINT AS steps, round(sx, 5) AS vx_sum, round(sd, 5) AS dist_sum FROM n WHERE rn >= 6""",
)
def sequence(spark, d) -> DataFrame:
    s = anomaly.feature_sequence(bridged(spark, d), length=6)

    def total(i: int):
        return F.round(
            F.aggregate("sequence", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(i)).cast("double")), 5
        )

    return s.select(
        "flight_id", "kf_seq", "track_id", F.size("sequence").cast("bigint").alias("steps"),
        total(0).alias("vx_sum"), total(8).alias("dist_sum"),
    )


@query(
    "score_sequences",
    f"""WITH {_BRIDGED}, g AS (SELECT *, kf_seq - row_number() OVER (PARTITION BY flight_id, track_id ORDER BY kf_seq) AS seg FROM bf),
    n AS (SELECT *, row_number() OVER w AS rn, avg(({' + '.join(f'CAST({f} AS DOUBLE) * {f}' for f in T.FEATURES[:6])}) / 6) OVER v AS e
      FROM g WINDOW w AS (PARTITION BY flight_id, track_id, seg ORDER BY kf_seq),
        v AS (PARTITION BY flight_id, track_id, seg ORDER BY kf_seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
    SELECT flight_id, kf_seq, track_id, round((e - 0.05) / 0.02, 4) AS ae FROM n WHERE rn >= 6""",
)
def scored(spark, d) -> DataFrame:
    s = anomaly.feature_sequence(bridged(spark, d), length=6)
    s = scoring.score_sequences(
        s, make_predict_fn=scoring.mean_square_speed(), length=6, mean=0.05, std=0.02
    )
    return s.select("flight_id", "kf_seq", "track_id", F.round("ae", 4).alias("ae"))


def scores(spark, d) -> DataFrame:
    """Bridged rows with the two wave scores."""
    t = V.tracks(spark, d).select("flight_id", "track_id", "kf_seq", "frame_id")
    b = T.bridge_gaps(t, V.keyframes(spark, d), max_age=V.MAX_AGE)
    return b.withColumns(
        {"ae": F.expr(f"CAST({V.AE_WAVE} AS DOUBLE)"), "soc": F.expr(f"CAST({V.SOC_WAVE} AS DOUBLE)")}
    )


def states(spark, d) -> DataFrame:
    return anomaly.score_states(
        scores(spark, d), length=V.SEQ_LEN, window=V.SMOOTH, min_duration=V.DURATION
    )


@query(
    "smoothed_score",
    f"""WITH {V.STATE_SQL} SELECT flight_id, track_id, kf_seq, eligible, round(ae_smooth, 6) AS ae_smooth,
      round(soc_smooth, 6) AS soc_smooth FROM sm""",
)
def smoothed(spark, d) -> DataFrame:
    s = anomaly.smoothed_score(scores(spark, d), length=V.SEQ_LEN, window=V.SMOOTH)
    return s.select("flight_id", "track_id", "kf_seq", "eligible", *rounded("ae_smooth", "soc_smooth"))


@query(
    "track_state",
    f"""WITH {V.STATE_SQL} SELECT flight_id, track_id, kf_seq, is_visible, ae_up, soc_up, flagged, confirmed, state FROM state""",
)
def state_query(spark, d) -> DataFrame:
    return states(spark, d).select(
        "flight_id", "track_id", "kf_seq", "is_visible", "ae_up", "soc_up", "flagged", "confirmed", "state"
    )


@query(
    "confirmed_flag",
    f"""WITH {V.STATE_SQL} SELECT flight_id, track_id, kf_seq, lasted >= 5 AS confirmed FROM st""",
)
def confirmed(spark, d) -> DataFrame:
    c = anomaly.confirmed_flag(states(spark, d).drop("confirmed"), min_duration=5)
    return c.select("flight_id", "track_id", "kf_seq", "confirmed")


@query(
    "elevated_sets",
    f"""WITH {V.STATE_SQL} SELECT flight_id, track_id, kf_seq, ae_up AND soc_up AS "both",
      ae_up AND NOT soc_up AS only_ae, soc_up AND NOT ae_up AS only_soc FROM state""",
)
def elevated(spark, d) -> DataFrame:
    e = anomaly.elevated_sets(states(spark, d))
    return e.select("flight_id", "track_id", "kf_seq", "both", "only_ae", "only_soc")


@query(
    "anomaly_events",
    f"""WITH RECURSIVE {V.STATE_SQL}, ord AS (
      SELECT *, first_value(frame_id) OVER (PARTITION BY flight_id, track_id, run ORDER BY kf_seq) AS f0 FROM state WHERE flagged),
    m AS (
      SELECT flight_id, track_id, run, lasted, frame_id, f0, ae_smooth AS ma, soc_smooth AS ms FROM ord WHERE lasted = 1
      UNION ALL
      SELECT o.flight_id, o.track_id, o.run, o.lasted, o.frame_id, o.f0,
        m.ma + (o.ae_smooth - m.ma) / (o.frame_id - o.f0 + 1), m.ms + (o.soc_smooth - m.ms) / (o.frame_id - o.f0 + 1)
      FROM m JOIN ord o ON o.flight_id = m.flight_id AND o.track_id = m.track_id AND o.run = m.run AND o.lasted = m.lasted + 1),
    fin AS (SELECT flight_id, track_id, run, arg_max(ma, lasted) AS mean_ae, arg_max(ms, lasted) AS mean_social FROM m GROUP BY 1, 2, 3),
    agg AS (SELECT flight_id, track_id, run, min(kf_seq) AS start_kf, max(kf_seq) AS end_kf, min(frame_id) AS start_frame,
      max(frame_id) AS end_frame, max(ts_us) - min(ts_us) AS duration_us, count(*) AS keyframe_count,
      CASE WHEN bool_or(ae_up) AND bool_or(soc_up) THEN 'both' WHEN bool_or(ae_up) THEN 'ae' ELSE 'social' END AS triggered_by,
      max(ae_smooth) AS max_ae, max(soc_smooth) AS max_social, avg(ae_smooth) AS avg_ae, avg(soc_smooth) AS avg_social
      FROM ord GROUP BY 1, 2, 3),
    lastk AS (SELECT flight_id, max(kf_seq) AS lk FROM kf GROUP BY 1)
    SELECT flight_id, track_id, start_kf, end_kf, start_frame, end_frame, duration_us, keyframe_count, triggered_by,
      round(max_ae, 6) AS max_ae, round(max_social, 6) AS max_social, round(avg_ae, 6) AS avg_ae, round(avg_social, 6) AS avg_social,
      round(mean_ae, 6) AS mean_ae, round(mean_social, 6) AS mean_social, end_kf = lk AS is_open
    FROM agg JOIN fin USING (flight_id, track_id, run) JOIN lastk USING (flight_id)
    WHERE end_kf = lk OR keyframe_count >= {V.DURATION}""",
)
def events(spark, d) -> DataFrame:
    e = anomaly.anomaly_events(
        cut(states(spark, d)), V.keyframes(spark, d), min_duration=V.DURATION
    )
    return e.select(
        "flight_id", "track_id", "start_kf", "end_kf", "start_frame", "end_frame", "duration_us",
        "keyframe_count", "triggered_by",
        *rounded("max_ae", "max_social", "avg_ae", "avg_social", "mean_ae", "mean_social"), "is_open",
    )


@query(
    "frame_summary",
    f"""WITH {V.STATE_SQL}, n AS (SELECT kf.flight_id, kf.frame_id, count(state) AS tracks,
        count(*) FILTER (WHERE state LIKE 'elevated%') AS elevated, count(*) FILTER (WHERE state LIKE 'confirmed%') AS confirmed
      FROM kf LEFT JOIN (SELECT * FROM state WHERE is_visible) s ON s.flight_id = kf.flight_id AND s.frame_id = kf.frame_id
      GROUP BY 1, 2)
    SELECT *, 'Frame ' || frame_id || ' | tracks=' || tracks || ' | elevated=' || elevated || ' | confirmed=' || confirmed AS hud
    FROM n""",
)
def summary(spark, d) -> DataFrame:
    """Every keyframe, those without a visible track with zeros."""
    return anomaly.frame_summary(states(spark, d), V.keyframes(spark, d))


_LISTS = [f"{s}_tracks" for s in anomaly.STATES]


@query(
    "ids_by_state",
    f"""WITH {V.STATE_SQL} SELECT flight_id, frame_id, """
    + ", ".join(
        f"coalesce(string_agg(CASE WHEN state = '{s}' THEN CAST(track_id AS VARCHAR) END, ',' ORDER BY track_id), '') AS {s}_tracks"
        for s in anomaly.STATES
    )
    + """, coalesce(string_agg(CASE WHEN state <> 'unscored' AND NOT ae_up THEN CAST(track_id AS VARCHAR) END, ',' ORDER BY track_id), '') AS ok_ae_tracks,
      coalesce(string_agg(CASE WHEN state <> 'unscored' AND NOT soc_up THEN CAST(track_id AS VARCHAR) END, ',' ORDER BY track_id), '') AS ok_soc_tracks
    FROM state GROUP BY 1, 2""",
)
def by_state(spark, d) -> DataFrame:
    g = anomaly.ids_by_state(states(spark, d))
    lists = [*_LISTS, "ok_ae_tracks", "ok_soc_tracks"]
    return g.select(
        "flight_id", "frame_id",
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in lists],
    )


@query(
    "track_label",
    f"""WITH {V.STATE_SQL} SELECT flight_id, track_id, kf_seq,
      CASE WHEN state LIKE 'confirmed%' THEN '0,0,255' WHEN state LIKE 'elevated%' THEN '0,220,220'
        WHEN state = 'ok' THEN '0,200,0' ELSE '180,130,70' END AS colour,
      'ID:' || track_id || CASE WHEN eligible THEN format(' ae={{:.2f}} soc={{:.2f}}', ae_smooth + 1e-9, soc_smooth + 1e-9) ELSE '' END AS label FROM state""",
)
def label(spark, d) -> DataFrame:
    # the SQL check nudges ties of the two-decimal rounding; do the same here
    s = states(spark, d).withColumns(
        {"ae_smooth": F.col("ae_smooth") + 1e-9, "soc_smooth": F.col("soc_smooth") + 1e-9}
    )
    return anomaly.track_label(s).select("flight_id", "track_id", "kf_seq", "colour", "label")


@query(
    "anomaly_message",
    f"""WITH {V.STATE_SQL}, g AS (SELECT flight_id, frame_id, string_agg(CASE WHEN is_visible AND state LIKE 'confirmed%'
      THEN CAST(track_id AS VARCHAR) END, ', ' ORDER BY track_id) AS ids FROM state GROUP BY 1, 2)
    SELECT flight_id, frame_id, CASE WHEN ids IS NULL THEN '' ELSE 'Anomaly: tracks [' || ids || ']' END AS alert_msg FROM g""",
)
def message(spark, d) -> DataFrame:
    return alerts.anomaly_message(states(spark, d))
