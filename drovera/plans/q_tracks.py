"""Track motion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tracks as T
from ..session import cut, sized
from . import views as V
from .registry import query

_R = [f"round(CAST({f} AS DOUBLE), 6) AS {f}" for f in T.FEATURES]


def rounded(*cols: str):
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]


@query(
    "keyframes",
    f"""WITH {V.EVENTS}, n AS (SELECT flight_id, event_id AS frame_id,
      row_number() OVER (PARTITION BY flight_id ORDER BY event_id) - 1 AS i FROM ev)
    SELECT flight_id, frame_id, i % 6 = 0 AS is_keyframe, i // 6 AS kf_seq FROM n""",
)
def keyframes(spark, d) -> DataFrame:
    f = V.events(spark, d).select("flight_id", F.col("event_id").alias("frame_id"))
    return T.keyframe_sampling(f).select("flight_id", "frame_id", "is_keyframe", "kf_seq")


@query(
    "track_center",
    f"""WITH {V.TRACKS} SELECT flight_id, kf_seq, track_id, cx, cy FROM tr""",
)
def center(spark, d) -> DataFrame:
    return T.track_center(V.tracks(spark, d).drop("cx", "cy")).select(
        "flight_id", "kf_seq", "track_id", "cx", "cy"
    )


@query(
    "track_segments",
    f"""WITH {V.VELOCITY} SELECT flight_id, kf_seq, track_id, CAST(sum(CASE WHEN new_segment THEN 1 ELSE 0 END)
      OVER (PARTITION BY flight_id, track_id ORDER BY kf_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM vel""",
)
def segments(spark, d) -> DataFrame:
    s = T.track_segments(V.tracks(spark, d), max_age=V.MAX_AGE)
    return s.select("flight_id", "kf_seq", "track_id", "segment")


def velocity(spark, d, keyframes: DataFrame | None = None) -> DataFrame:
    keyframes = sized(V.keyframes(spark, d)) if keyframes is None else keyframes
    return T.world_velocity(V.tracks(spark, d), keyframes, max_age=V.MAX_AGE)


@query(
    "world_velocity",
    f"""WITH {V.VELOCITY} SELECT flight_id, kf_seq, track_id, round(vx, 6) AS vx, round(vy, 6) AS vy, new_segment FROM vel""",
)
def velocity_query(spark, d) -> DataFrame:
    return velocity(spark, d).select(
        "flight_id", "kf_seq", "track_id", *rounded("vx", "vy"), "new_segment"
    )


def features(spark, d, keyframes: DataFrame | None = None) -> DataFrame:
    cols = ("flight_id", "frame_id", "kf_seq", "track_id", "cx", "cy", "vx", "vy")
    # extents, candidates, places and rows all read the velocities
    v = cut(velocity(spark, d, keyframes).select(*cols))
    return T.knn_features(v, k=V.KNN_K, extents=sized(T.keyframe_extents(v)))


@query(
    "knn_features",
    f"WITH {V.FEATURE_SQL} SELECT flight_id, kf_seq, track_id, {', '.join(_R)} FROM feat",
)
def knn(spark, d) -> DataFrame:
    return features(spark, d).select("flight_id", "kf_seq", "track_id", *rounded(*T.FEATURES))


@query(
    "knn_features_large_frames",
    f"WITH {V.FEATURE_SQL} SELECT flight_id, kf_seq, track_id, {', '.join(_R)} FROM feat",
)
def knn_large(spark, d) -> DataFrame:
    """The search of large keyframes (tiles, then cells of every level) for every keyframe."""
    v = cut(velocity(spark, d).select("flight_id", "frame_id", "kf_seq", "track_id", "cx", "cy", "vx", "vy"))
    f = T.knn_features(v, k=V.KNN_K, one_level=0, extents=sized(T.keyframe_extents(v)))
    return f.select("flight_id", "kf_seq", "track_id", *rounded(*T.FEATURES))


def bridged(spark, d) -> DataFrame:
    keyframes = sized(V.keyframes(spark, d))
    return T.bridge_gaps(features(spark, d, keyframes), keyframes, max_age=V.MAX_AGE)


@query(
    "bridge_gaps",
    f"""WITH {V.FEATURE_SQL}{V.BRIDGE_SQL.format(src='feat', out='bf')}
    SELECT flight_id, kf_seq, frame_id, track_id, is_visible, {', '.join(_R)} FROM bf""",
)
def bridge(spark, d) -> DataFrame:
    return bridged(spark, d).select(
        "flight_id", "kf_seq", "frame_id", "track_id", "is_visible", *rounded(*T.FEATURES)
    )


_NEXT = "(SELECT flight_id, track_id, kf_seq - 1 AS kf_seq FROM tr)"


@query(
    "present_tracks",
    f"WITH {V.TRACKS} SELECT flight_id, kf_seq, track_id FROM tr SEMI JOIN {_NEXT} n USING (flight_id, track_id, kf_seq)",
)
def present(spark, d) -> DataFrame:
    t = V.tracks(spark, d).select("flight_id", "kf_seq", "track_id")
    return T.present_tracks(t, t.withColumn("kf_seq", F.col("kf_seq") - 1))


@query(
    "absent_tracks",
    f"WITH {V.TRACKS} SELECT flight_id, kf_seq, track_id FROM tr ANTI JOIN {_NEXT} n USING (flight_id, track_id, kf_seq)",
)
def absent(spark, d) -> DataFrame:
    t = V.tracks(spark, d).select("flight_id", "kf_seq", "track_id")
    return T.absent_tracks(t, t.withColumn("kf_seq", F.col("kf_seq") - 1))


# three animals per keyframe, the trio shifting with the keyframe number
_BOX = {
    "x1": "CAST((frame_id * 7 + track_id * 31) % 1000 AS DOUBLE)",
    "y1": "CAST((frame_id * 3 + track_id * 17) % 500 AS DOUBLE)",
    "x2": "CAST((frame_id * 7 + track_id * 31) % 1000 + 40 AS DOUBLE)",
    "y2": "CAST((frame_id * 3 + track_id * 17) % 500 + 30 AS DOUBLE)",
    "confidence": "CAST(track_id AS DOUBLE) / 8",
    "class_id": "track_id % 2",
}


@query(
    "interpolate_tracks",
    f"""WITH {V.EVENTS}, n AS (SELECT flight_id, event_id AS frame_id, ts_us,
      row_number() OVER (PARTITION BY flight_id ORDER BY event_id) - 1 AS i FROM ev),
    k AS (SELECT flight_id, frame_id, i // 6 AS kf FROM n WHERE i % 6 = 0),
    t0 AS (SELECT flight_id, frame_id, kf, kf % 4 + o AS track_id FROM k, (VALUES (0), (1), (2)) v(o)),
    t AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _BOX.items())} FROM t0),
    common AS (SELECT a.flight_id, a.kf, a.track_id, a.confidence, a.class_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2,
      b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM t a JOIN t b
      ON b.flight_id = a.flight_id AND b.kf = a.kf + 1 AND b.track_id = a.track_id),
    p AS (SELECT n.flight_id, n.frame_id, n.i // 6 AS kf, (n.i % 6) / 6.0::DOUBLE AS al FROM n
      WHERE i % 6 <> 0 AND EXISTS (SELECT 1 FROM k WHERE k.flight_id = n.flight_id AND k.kf = n.i // 6 + 1))
    SELECT p.flight_id, p.frame_id, c.track_id, c.confidence, CAST(c.class_id AS BIGINT) AS class_id,
      {', '.join(f'round((1 - al) * a{b} + al * b{b}, 6) AS {b}' for b in ('x1', 'y1', 'x2', 'y2'))}
    FROM p LEFT JOIN common c USING (flight_id, kf)""",
)
def interpolate(spark, d) -> DataFrame:
    f = V.events(spark, d).select("flight_id", F.col("event_id").alias("frame_id"), "ts_us")
    f = cut(T.keyframe_sampling(f))
    t = (
        f.filter("is_keyframe")
        .withColumn("track_id", F.explode(F.sequence(F.expr("kf_seq % 4"), F.expr("kf_seq % 4 + 2"))))
        .select("flight_id", "frame_id", "track_id", *[F.expr(e).alias(n) for n, e in _BOX.items()])
    )
    out = T.interpolate_tracks(f, t)
    return out.select(
        "flight_id", "frame_id", "track_id", "confidence",
        F.col("class_id").cast("bigint").alias("class_id"), *rounded("x1", "y1", "x2", "y2"),
    )
