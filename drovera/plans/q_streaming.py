"""Streams over the bundled events, drained to tables; the SQL is that of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import telemetry
from ..streaming import eventtime, stateful
from ..streaming.run import drain, drain_updates, scratch
from . import views as V
from .q_alerts import _GAP
from .registry import ORACLES, query

EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def event_stream(spark, d) -> DataFrame:
    raw = (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(d)
    )
    return raw.select(
        F.expr("user_id % 10").alias("flight_id"), "event_id", F.expr(V.TS_US).alias("ts_us"),
        "user_id", "event_type", "value",
    )


def end_marker(spark, d) -> DataFrame:
    """A stream of one late row of no flight; it moves the watermark past the last real event."""
    folder = scratch(spark, "end")
    V.events(spark, d).agg(F.max("ts_us").alias("m")).select(
        F.lit(-1).cast("bigint").alias("flight_id"), F.lit(-1).cast("bigint").alias("event_id"),
        (F.col("m") + 30 * 24 * V.HOUR_US).alias("ts_us"), F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("purchase").alias("event_type"), F.lit(0.0).alias("value"),
    ).write.parquet(folder)
    schema = (
        "flight_id BIGINT, event_id BIGINT, ts_us BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"
    )
    return spark.readStream.schema(schema).parquet(folder)


def _messages(events: DataFrame) -> DataFrame:
    return events.select(
        "flight_id", F.col("event_id").alias("seq"), "ts_us", F.expr(V._TOPIC).alias("topic"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE cast(value AS string) END").alias("payload"),
    )


@query("stream_snapshot", None)
def snapshot(spark, d) -> DataFrame:
    stateful.use_rocksdb(spark)
    decoded = telemetry.decode_telemetry(_messages(event_stream(spark, d)))
    return drain(stateful.locf(decoded), "snapshot")


@query("stream_asof", None)
def asof(spark, d) -> DataFrame:
    """The right side is the batch snapshot table read as a stream, as a log of snapshots would be."""
    from .q_telemetry import snapshots

    stateful.use_rocksdb(spark)
    folder = scratch(spark, "snapshots")
    snap = snapshots(spark, d)
    snap.write.parquet(folder)
    right = spark.readStream.schema(snap.schema).parquet(folder)
    left = event_stream(spark, d).unionByName(end_marker(spark, d))
    left = left.filter("event_type = 'purchase'").select(
        "flight_id", F.col("event_id").alias("frame_id"), "ts_us"
    )
    out = drain(
        stateful.asof(left, right, tol_us=V.TOL_US, bucket_us=V.KEYFRAME_US), "asof"
    )
    return out.filter("flight_id >= 0")


def _candidates(events: DataFrame, *kept: str) -> DataFrame:
    message = "CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE '' END"
    return events.select(
        "flight_id", F.col("event_id").alias("frame_id"), "ts_us", F.expr(message).alias("alert_msg"), *kept
    )


@query("stream_cooldown", None)
def cooldown(spark, d) -> DataFrame:
    stateful.use_rocksdb(spark)
    c = _candidates(event_stream(spark, d))
    return drain(stateful.cooldown(c, cooldown_us=V.COOLDOWN_US), "cooldown")


@query("stream_latest_alert", None)
def latest(spark, d) -> DataFrame:
    """What the stream last said of each flight, after six micro-batches with disorder."""
    stateful.use_rocksdb(spark)
    c = arrivals(spark, d, lambda e: _candidates(e, "_arrival")).filter("alert_msg <> ''")
    said = drain_updates(stateful.latest(c), "latest")
    row = F.max_by(F.struct("frame_id", "ts_us", "alert_msg"), "batch").alias("_a")
    return said.groupBy("flight_id").agg(row).select("flight_id", "_a.*")


@query("stream_sessions", None)
def sessions(spark, d) -> DataFrame:
    e = event_stream(spark, d).unionByName(end_marker(spark, d))
    s = stateful.sessions(e, key="user_id", gap=f"{_GAP // 1_000_000} seconds")
    return drain(s, "sessions").filter("user_id >= 0")


for _stream, _batch in (
    ("stream_snapshot", "telemetry_snapshot"),
    ("stream_asof", "asof_nearest"),
    ("stream_cooldown", "alert_cooldown"),
    ("stream_latest_alert", "latest_alert"),
    ("stream_sessions", "session_close"),
):
    ORACLES[_stream] = ORACLES[_batch]


# ---------------------------------------------------------------- event time

# Events arrive in six files; every thirteenth comes with the file after its own, which is too late
# where its flight has moved on by more than the delay.
_FILES = 6
_DELAY_US = 36 * V.HOUR_US
_ARRIVAL = "cast(floor((event_id + CASE WHEN event_id % 13 = 0 THEN _n / 5.0 ELSE 0 END) * 5 / _n) AS bigint)"
_ON_TIME = f"""arrived AS (SELECT *, {_ARRIVAL} AS arrival FROM ev, (SELECT count(*) AS _n FROM ev) q),
  judged AS (SELECT *, coalesce(ts_us < max(ts_us) OVER (PARTITION BY flight_id ORDER BY arrival
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DELAY_US}, false) AS is_late FROM arrived)"""


def arrivals(spark, d, shape) -> DataFrame:
    """The events as a stream of files in the order of their arrival, one file per micro-batch."""
    folder = scratch(spark, "arrivals")
    e = V.events(spark, d)
    n = e.count()
    rows = shape(e.withColumn("_n", F.lit(n)).withColumn("_arrival", F.expr(_ARRIVAL)))
    for k in range(_FILES):
        rows.filter(F.col("_arrival") == k).drop("_arrival").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop("_arrival").schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _decoded(e: DataFrame) -> DataFrame:
    m = e.select(
        "flight_id", F.col("event_id").alias("seq"), "ts_us", F.expr(V._TOPIC).alias("topic"), "_arrival",
        F.expr("CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE cast(value AS string) END").alias("payload"),
    )
    return telemetry.decode_telemetry(m).select("flight_id", "seq", "ts_us", "field", "value", "_arrival")


# late rows are judged among decoded messages only
_LATE_SQL = V.DECODED + f""", arrived AS (SELECT d.*, {_ARRIVAL.replace("event_id", "seq")} AS arrival
    FROM decoded d, (SELECT count(*) AS _n FROM ev) q),
  judged AS (SELECT *, coalesce(ts_us < max(ts_us) OVER (PARTITION BY flight_id ORDER BY arrival
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DELAY_US}, false) AS is_late FROM arrived)"""


def _snapshots(spark, d) -> eventtime.EventTimeResult:
    log = eventtime.snapshot_log(scratch(spark, "event-time"), delay_us=_DELAY_US)
    return log.drain(arrivals(spark, d, _decoded))


@query(
    "event_time_snapshot",
    f"WITH {_LATE_SQL}"
    + V.SNAPSHOT[len(V.DECODED):].replace("FROM decoded", "FROM judged WHERE NOT is_late")
    + " SELECT flight_id, seq, ts_us, latitude, longitude, rel_alt, gb_yaw FROM snap",
)
def event_time_snapshot(spark, d) -> DataFrame:
    """Snapshots of the messages on time, over six micro-batches with disorder."""
    return _snapshots(spark, d).rows.drop("epoch")


@query(
    "late_rows",
    f"WITH {_LATE_SQL} SELECT flight_id, arrival AS epoch, count(*) AS late_rows, min(seq) AS first_seq FROM judged WHERE is_late GROUP BY 1, 2",
)
def late_rows(spark, d) -> DataFrame:
    """What came behind its flight's watermark, per flight and micro-batch."""
    late = _snapshots(spark, d).late
    return late.groupBy("flight_id", F.col("epoch").cast("bigint").alias("epoch")).agg(
        F.count(F.lit(1)).alias("late_rows"), F.min("seq").alias("first_seq")
    )


@query(
    "event_time_cooldown",
    f"""WITH RECURSIVE {V.EVENTS}, {_ON_TIME}, cand AS (SELECT flight_id, event_id AS frame_id, ts_us, event_type AS alert_msg
      FROM judged WHERE NOT is_late AND event_type IN ('error', 'purchase')),
    walk AS (
      SELECT flight_id, min(ts_us) AS ts_us FROM cand GROUP BY 1
      UNION ALL
      SELECT w.flight_id, (SELECT min(c.ts_us) FROM cand c WHERE c.flight_id = w.flight_id
        AND c.ts_us >= w.ts_us + {V.COOLDOWN_US}) FROM walk w WHERE w.ts_us IS NOT NULL)
    SELECT c.flight_id, c.frame_id, c.ts_us, c.alert_msg FROM cand c JOIN walk w USING (flight_id, ts_us)""",
)
def event_time_cooldown(spark, d) -> DataFrame:
    """Rate-limited alerts in event time, over six micro-batches with disorder."""
    log = eventtime.cooldown_log(scratch(spark, "event-time"), cooldown_us=V.COOLDOWN_US, delay_us=_DELAY_US)
    rows = arrivals(spark, d, lambda e: e.select(
        "flight_id", F.col("event_id").alias("frame_id"), "ts_us",
        F.expr("CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE '' END").alias("alert_msg"), "_arrival",
    ))
    return log.drain(rows).rows.drop("epoch")
