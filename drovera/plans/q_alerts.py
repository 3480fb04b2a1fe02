"""Alert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts
from ..sources import sinks
from . import views as V
from .registry import query


@query("alert_cooldown", f"WITH RECURSIVE {V.PASSED} SELECT flight_id, frame_id, ts_us, alert_msg FROM passed")
def cooldown(spark, d) -> DataFrame:
    a = alerts.alert_cooldown(V.alert_candidates(spark, d), cooldown_us=V.COOLDOWN_US)
    return a.select("flight_id", "frame_id", "ts_us", "alert_msg")


def alert_rows(spark, d) -> DataFrame:
    return V.alert_candidates(spark, d).filter("alert_msg <> ''")


@query(
    "latest_alert",
    f"""WITH {V.ALERTS} SELECT flight_id, frame_id, ts_us, alert_msg FROM al WHERE alert_msg <> ''
      QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY ts_us DESC, frame_id DESC) = 1""",
)
def latest(spark, d) -> DataFrame:
    return alerts.latest_alert(alert_rows(spark, d))


@query("alert_totals", f"WITH {V.ALERTS} SELECT flight_id, count(*) AS alerts FROM al WHERE alert_msg <> '' GROUP BY 1")
def totals(spark, d) -> DataFrame:
    return alerts.alert_totals(alert_rows(spark, d))


_SINCE = V.BASE_US + 20 * 24 * V.HOUR_US


@query(
    "alerts_since",
    f"WITH {V.ALERTS} SELECT flight_id, frame_id, ts_us, alert_msg FROM al WHERE alert_msg <> '' AND ts_us > {_SINCE}",
)
def since(spark, d) -> DataFrame:
    return alerts.alerts_since(alert_rows(spark, d), _SINCE)


@query(
    "stage_throughput",
    f"""WITH {V.EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY flight_id ORDER BY event_id) - 1) // 30 AS window_no FROM ev)
    SELECT flight_id, window_no, count(*) AS frames, max(user_id) AS backlog_max, round(avg(value) * 1000, 4) AS proc_avg_ms,
      round(max(value) * 1000, 4) AS proc_max_ms FROM n GROUP BY 1, 2""",
)
def throughput(spark, d) -> DataFrame:
    e = V.events(spark, d).select(
        "flight_id", F.col("event_id").alias("frame_id"), F.col("user_id").alias("backlog"),
        F.col("value").alias("proc_s"),
    )
    t = alerts.stage_throughput(e)
    return t.withColumns(
        {"proc_avg_ms": F.round("proc_avg_ms", 4), "proc_max_ms": F.round("proc_max_ms", 4)}
    )


_GAP = 2 * V.HOUR_US


@query(
    "session_close",
    f"""WITH {V.EVENTS}, g AS (SELECT user_id, ts_us, CASE WHEN ts_us - lag(ts_us) OVER w >= {_GAP} THEN 1 ELSE 0 END AS fresh
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_us)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS id FROM g)
    SELECT user_id, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS events, max(ts_us) + {_GAP} AS close_us
    FROM s GROUP BY user_id, id""",
)
def sessions(spark, d) -> DataFrame:
    return alerts.session_close(V.events(spark, d), gap_us=_GAP, keys=("user_id",))


_ISO = "strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE strftime(make_timestamp(ts_us), '.%f') END"


@query(
    "alert_payload",
    f"""WITH {V.ALERTS} SELECT flight_id, frame_id, alert_msg, ts_us / 1000000 AS "timestamp", {_ISO} AS datetime,
      to_base64(encode(alert_msg)) AS image, 1920::BIGINT AS width, 1080::BIGINT AS height, 'jpeg' AS compression
    FROM al WHERE alert_msg <> ''""",
)
def payload(spark, d) -> DataFrame:
    a = alert_rows(spark, d).withColumns(
        {"image": F.encode("alert_msg", "UTF-8"), "orig_w": F.lit(1920), "orig_h": F.lit(1080)}
    )
    p = alerts.alert_payload(a)
    return p.withColumns({"width": F.col("width").cast("bigint"), "height": F.col("height").cast("bigint")})


@query(
    "alert_rows",
    f"""WITH {V.ALERTS} SELECT flight_id, alert_msg, frame_id, ts_us / 1000000 AS "timestamp", ts_us AS datetime_us,
      length(alert_msg) AS image_bytes FROM al WHERE alert_msg <> ''""",
)
def stored(spark, d) -> DataFrame:
    a = alert_rows(spark, d).withColumns(
        {"image": F.encode("alert_msg", "UTF-8"), "orig_w": F.lit(1920), "orig_h": F.lit(1080)}
    )
    r = sinks.new_alert_rows(sinks.alert_rows(alerts.alert_payload(a)), None)
    return r.select(
        "flight_id", "alert_msg", "frame_id", "timestamp", F.unix_micros("datetime").alias("datetime_us"),
        F.length("image_data").cast("bigint").alias("image_bytes"),
    )


@query(
    "alert_log_lines",
    f"""WITH {V.ALERTS} SELECT frame_id, alert_msg, ts_us AS ts_us, {_ISO} AS datetime FROM al WHERE alert_msg <> ''""",
)
def log_lines(spark, d) -> DataFrame:
    """The JSON lines, read back."""
    lines = sinks.alert_log_lines(alert_rows(spark, d))
    j = F.from_json("value", "frame_id BIGINT, alert_msg STRING, timestamp DOUBLE, datetime STRING")
    return lines.select(j.alias("j")).select(
        "j.frame_id", "j.alert_msg", F.round(F.col("j.timestamp") * 1_000_000).cast("bigint").alias("ts_us"),
        "j.datetime",
    )
