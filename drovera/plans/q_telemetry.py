"""Telemetry and ground-resolution queries, including the flagship frame geolocation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import geo, telemetry
from ..session import cut
from ..settings import Camera
from ..sources import readers
from ..streaming.run import scratch
from . import views as V
from .registry import query

_RES = (
    f"(({{alt}} / {C.FOCAL_LENGTH_MM}) * (CAST({C.SENSOR_WIDTH_MM} AS DOUBLE) / {C.SENSOR_WIDTH_PX}.0) "
    f"* least({C.SENSOR_WIDTH_PX}.0::DOUBLE / 1280, {C.SENSOR_HEIGHT_PX}.0::DOUBLE / 720))"
)


@query(
    "decode_telemetry",
    f"WITH {V.DECODED} SELECT flight_id, seq, ts_us, field, value FROM decoded",
)
def decode(spark, d) -> DataFrame:
    return telemetry.decode_telemetry(V.messages(spark, d)).select(
        "flight_id", "seq", "ts_us", "field", "value"
    )


def snapshots(spark, d) -> DataFrame:
    return telemetry.telemetry_snapshot(telemetry.decode_telemetry(V.messages(spark, d)))


@query(
    "telemetry_snapshot",
    f"WITH {V.SNAPSHOT} SELECT flight_id, seq, ts_us, latitude, longitude, rel_alt, gb_yaw FROM snap",
)
def snapshot(spark, d) -> DataFrame:
    return snapshots(spark, d)


def matched(spark, d) -> DataFrame:
    # the join reads its right side several times (densities, block summaries, rows)
    return telemetry.asof_nearest(V.frames(spark, d), cut(snapshots(spark, d)), tol_us=V.TOL_US)


@query(
    "asof_nearest",
    f"""WITH {V.MATCHED} SELECT flight_id, frame_id, ts_us, match_dt_us, latitude, longitude,
      rel_alt, gb_yaw FROM matched""",
)
def asof(spark, d) -> DataFrame:
    return matched(spark, d).select(
        "flight_id", "frame_id", "ts_us", "match_dt_us", "telemetry.latitude",
        "telemetry.longitude", "telemetry.rel_alt", "telemetry.gb_yaw",
    )


@query(
    "match_quality",
    f"""WITH {V.MATCHED} SELECT flight_id, count(*) AS frames,
      count(*) FILTER (WHERE match_dt_us IS NULL) AS failed_matches FROM matched GROUP BY 1""",
)
def quality(spark, d) -> DataFrame:
    return telemetry.match_quality(matched(spark, d))


@query(
    "match_streak",
    f"""WITH {V.EVENTS}, m AS (
      SELECT flight_id, event_id AS frame_id, value < 15 AS missed FROM ev),
    g AS (
      SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY frame_id)
        - row_number() OVER (PARTITION BY flight_id, missed ORDER BY frame_id) AS run FROM m)
    SELECT flight_id, frame_id, CASE WHEN missed THEN row_number() OVER (
      PARTITION BY flight_id, missed, run ORDER BY frame_id) ELSE 0 END AS miss_streak FROM g""",
)
def streak(spark, d) -> DataFrame:
    m = V.events(spark, d).select("flight_id", F.col("event_id").alias("frame_id"), "value")
    return telemetry.miss_streak(m, missed=F.col("value") < 15).select(
        "flight_id", "frame_id", "miss_streak"
    )


@query(
    "recent_telemetry",
    f"""WITH {V.EVENTS} SELECT flight_id, event_id AS seq, value FROM ev
      QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY ts_us DESC, event_id DESC) <= {C.TELEMETRY_BUFFER}""",
)
def recent(spark, d) -> DataFrame:
    e = V.events(spark, d).withColumnRenamed("event_id", "seq")
    return telemetry.last_n(e, order=("ts_us", "seq"), n=C.TELEMETRY_BUFFER).select(
        "flight_id", "seq", "value"
    )


@query(
    "ground_resolution",
    f"""WITH {V.EVENTS} SELECT event_id, round({_RES.format(alt='value')}, 9) AS meters_per_pixel FROM ev""",
)
def resolution(spark, d) -> DataFrame:
    e = V.events(spark, d).withColumns({"image_w": F.lit(1280), "image_h": F.lit(720)})
    return geo.meters_per_pixel(e, alt="value").select(
        "event_id", F.round("meters_per_pixel", 9).alias("meters_per_pixel")
    )


@query(
    "safety_radius",
    f"""WITH {V.EVENTS} SELECT event_id,
      CAST(trunc(2.0 / {_RES.format(alt='value')}) AS BIGINT) AS safety_radius_px FROM ev""",
)
def radius(spark, d) -> DataFrame:
    e = V.events(spark, d).withColumns({"image_w": F.lit(1280), "image_h": F.lit(720)})
    e = geo.safety_radius_px(geo.meters_per_pixel(e, alt="value"))
    return e.select("event_id", F.col("safety_radius_px").cast("bigint").alias("safety_radius_px"))


_FALLBACK = """fb AS (
  SELECT frame_id, median(greatest(w, h)) AS med FROM bx GROUP BY 1)"""


@query(
    "fallback_radius",
    f"""WITH {V.BOXES}, {_FALLBACK} SELECT o_orderkey AS frame_id,
      CASE WHEN med > 0 THEN CAST(trunc(2.0::DOUBLE / (1.3::DOUBLE / med)) AS BIGINT) ELSE -1 END AS safety_radius_px
      FROM orders LEFT JOIN fb ON frame_id = o_orderkey""",
)
def fallback(spark, d) -> DataFrame:
    frames = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"))
    out = geo.fallback_radius(frames, sized_boxes(spark, d), keys=("frame_id",))
    return out.select("frame_id", F.col("safety_radius_px").cast("bigint").alias("safety_radius_px"))


def sized_boxes(spark, d) -> DataFrame:
    b = V.box_lines(spark, d, "frame_id", "cx", "cy", "w", "h")
    return b.select(
        "frame_id",
        (F.col("cx") - F.col("w")).alias("x1"), F.col("cx").alias("x2"),
        (F.col("cy") - F.col("h")).alias("y1"), F.col("cy").alias("y2"),
    )


def frame_geo(spark, d, *, camera: Camera = Camera()) -> DataFrame:
    """Where the drone was at every frame and how large the safety circle is."""
    m = matched(spark, d).withColumns({"image_w": F.lit(1280), "image_h": F.lit(720)})
    m = m.withColumn("rel_alt", F.col("telemetry.rel_alt"))
    m = geo.safety_radius_px(geo.meters_per_pixel(m, camera=camera))
    return geo.fallback_radius(
        m, sized_boxes(spark, d), keys=("frame_id",), out="fallback_px"
    ).select(
        "flight_id", "frame_id", "ts_us", "telemetry", "match_dt_us", "meters_per_pixel",
        F.when(F.col("telemetry").isNull(), F.col("fallback_px"))
        .otherwise(F.col("safety_radius_px")).alias("safety_radius_px"),
    )


@query(
    "frame_geo",
    f"""WITH {V.MATCHED}, {V.BOXES}, {_FALLBACK}
    SELECT m.flight_id, m.frame_id, m.ts_us, m.match_dt_us, m.latitude, m.longitude, m.gb_yaw,
      round({_RES.format(alt='m.rel_alt')}, 9) AS meters_per_pixel,
      CASE WHEN m.match_dt_us IS NOT NULL THEN CAST(trunc(2.0 / {_RES.format(alt='m.rel_alt')}) AS BIGINT)
        WHEN med > 0 THEN CAST(trunc(2.0::DOUBLE / (1.3::DOUBLE / med)) AS BIGINT) ELSE -1 END AS safety_radius_px
    FROM matched m LEFT JOIN fb ON fb.frame_id = m.frame_id""",
)
def frame_geo_query(spark, d) -> DataFrame:
    return frame_geo(spark, d).select(
        "flight_id", "frame_id", "ts_us", "match_dt_us", "telemetry.latitude",
        "telemetry.longitude", "telemetry.gb_yaw",
        F.round("meters_per_pixel", 9).alias("meters_per_pixel"),
        F.col("safety_radius_px").cast("bigint").alias("safety_radius_px"),
    )


# ---------------------------------------------------------------- flight log

_WALL = "2021-03-02 08:15:00.250"


@query(
    "flight_log",
    f"""WITH {V.EVENTS} SELECT event_id AS frame_cnt, user_id AS diff_ms, '{_WALL}' AS wall,
      CAST(event_id % 180 AS DOUBLE) / 2 AS latitude, -CAST(event_id % 360 AS DOUBLE) / 4 AS longitude,
      CAST(user_id AS DOUBLE) AS rel_alt, CAST(user_id % 7 AS DOUBLE) AS gb_roll FROM ev""",
)
def flight_log(spark, d) -> DataFrame:
    """Events written as log records, every other one with other line ends, and read again."""
    folder = scratch(spark, "flight-log")
    end = F.when(F.col("event_id") % 2 == 0, "\r\n").otherwise("\n")
    lines = (
        ("%d", "event_id"), ("00:00:00,000 --> 00:00:00,040",), ('<font size="20">FrameCnt: %d, DiffTime: %dms', "event_id", "user_id"),
        (_WALL,),
    )
    text = [F.format_string(form, *cols) if cols else F.lit(form) for form, *cols in lines]
    number = lambda e: F.expr(f"cast({e} AS string)")
    tail = F.concat(
        F.lit("[iso: 400] [latitude: "), number("cast(event_id % 180 AS double) / 2"), F.lit("] [longitude: "),
        number("0 - cast(event_id % 360 AS double) / 4"), F.lit("] [rel_alt: "), number("cast(user_id AS double)"),
        F.lit(" abs_alt: 1.0] [gb_yaw: 0.5 gb_pitch: -1.25 gb_roll: "), number("cast(user_id % 7 AS double)"), F.lit("] </font>"),
    )
    V.events(spark, d).select(F.concat_ws("", *[F.concat(t, end) for t in [*text, tail]], end).alias("value")).write.text(folder)
    found = readers.read_flight_log(spark, folder)
    return found.select(
        "frame_cnt", F.col("diff_ms").cast("bigint").alias("diff_ms"), F.date_format("wall_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("wall"),
        "latitude", "longitude", "rel_alt", "gb_roll",
    )
