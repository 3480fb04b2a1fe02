"""Structured Streaming forms of the stateful operators.

They need the RocksDB state store (``use_rocksdb``). State is keyed by flight, or by flight and
time bucket where the operator allows it, and rows of one micro-batch are put in event-time order
inside the processor.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _batch(rows: Iterator[pd.DataFrame], by: Sequence[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), ignore_index=True)


# ---------------------------------------------------------------- snapshots


class _Snapshot(StatefulProcessor):
    """Last value of every field of one flight."""

    def __init__(self, template: Mapping[str, float]):
        self.template = dict(template)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField(f, T.DoubleType()) for f in self.template]
        self.last = handle.getValueState("last", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["seq"])
        start = dict(zip(self.template, self.last.get())) if self.last.exists() else self.template
        out = pdf[["seq", "ts_us"]].copy()
        out.insert(0, "flight_id", key[0])
        for f in self.template:
            mine = pdf["value"].where(pdf["field"] == f)
            out[f] = mine.ffill().fillna(start[f])
        self.last.update(tuple(float(out[f].iloc[-1]) for f in self.template))
        yield out

    def close(self) -> None:
        pass


def locf(decoded: DataFrame, *, template: Mapping[str, float] = C.TELEMETRY_TEMPLATE) -> DataFrame:
    """Streaming ``telemetry_snapshot`` over decoded messages."""
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("flight_id", "seq", "ts_us")]
        + [T.StructField(f, T.DoubleType()) for f in template]
    )
    return decoded.groupBy("flight_id").transformWithStateInPandas(
        _Snapshot(template), schema, "Append", "None"
    )


# ---------------------------------------------------------------- as-of


class _Asof(StatefulProcessor):
    """Holds one (flight, bucket) until the watermark passes it, then matches it as a whole."""

    def __init__(self, tol_us: int, bucket_us: int, cols: Sequence[str]):
        self.tol_us, self.bucket_us, self.cols = tol_us, bucket_us, list(cols)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [
            T.StructField("side", T.IntegerType()), T.StructField("ts_us", T.LongType()),
            T.StructField("id", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in self.cols],
        ]
        self.rows = handle.getListState("rows", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            due_us = (int(key[1]) + 1) * self.bucket_us + self.tol_us
            self.handle.registerTimer(due_us // 1000 + 1)
        for pdf in rows:
            pdf = pdf[["side", "ts_us", "id", *self.cols]]
            self.rows.appendList(
                [(int(r[0]), int(r[1]), int(r[2]), *map(_number, r[3:]))
                 for r in pdf.itertuples(index=False)]
            )
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pdf = pd.DataFrame(list(self.rows.get()), columns=["side", "ts_us", "id", *self.cols])
        self.rows.clear()
        left = pdf[pdf["side"] == 1].sort_values(["ts_us", "id"], ignore_index=True)
        if left.empty:
            return
        right = pdf[pdf["side"] == 0].sort_values(["ts_us", "id"])
        right = right.drop_duplicates("ts_us", keep="first", ignore_index=True)
        out = pd.DataFrame({"flight_id": key[0], "frame_id": left["id"], "ts_us": left["ts_us"]})
        gap = np.full(len(left), np.iinfo(np.int64).max)
        pick = np.zeros(len(left), dtype=np.int64)
        if len(right):
            t, r = left["ts_us"].to_numpy(), right["ts_us"].to_numpy()
            after = np.searchsorted(r, t, side="right")
            prev, nxt = np.maximum(after - 1, 0), np.minimum(after, len(r) - 1)
            d_prev, d_next = np.abs(t - r[prev]), np.abs(r[nxt] - t)
            pick = np.where(d_prev <= d_next, prev, nxt)
            gap = np.minimum(d_prev, d_next)
        hit = gap <= self.tol_us
        out["match_dt_us"] = pd.Series(gap, dtype="Int64").where(hit)
        for c in self.cols:
            values = right[c].to_numpy()[pick] if len(right) else np.full(len(left), np.nan)
            out[c] = np.where(hit, values, np.nan)
        yield out

    def close(self) -> None:
        pass


def _number(v) -> float | None:
    return None if v is None or v != v else float(v)


def asof(
    frames: DataFrame,
    telemetry: DataFrame,
    *,
    tol_us: int = C.MATCH_TOLERANCE_US,
    cols: Sequence[str] = ("latitude", "longitude", "rel_alt", "gb_yaw"),
    bucket_us: int = 10_000_000,
    watermark: str = "1 second",
) -> DataFrame:
    """Streaming ``asof_nearest``: the same answers, emitted once the watermark has passed.

    State lives per (flight, time bucket) and ends with the bucket. Telemetry within the tolerance
    of a bucket border also goes to the neighbour, so every bucket is matched on its own.
    """
    if bucket_us < tol_us:
        raise ValueError("a bucket must be at least as long as the tolerance")
    own = F.expr(f"(ts_us - pmod(ts_us, {bucket_us}L)) div {bucket_us}L")
    pos = F.expr(f"pmod(ts_us, {bucket_us}L)")
    homes = F.array_compact(
        F.array(own, F.when(pos <= tol_us, own - 1), F.when(pos >= bucket_us - tol_us, own + 1))
    )
    no = [F.lit(None).cast("double").alias(c) for c in cols]
    left = frames.select(
        "flight_id", own.alias("bucket"), F.lit(1).alias("side"), "ts_us",
        F.col("frame_id").alias("id"), *no,
    )
    right = telemetry.select(
        "flight_id", F.explode(homes).alias("bucket"), F.lit(0).alias("side"), "ts_us",
        F.col("seq").alias("id"), *cols,
    )
    both = left.unionByName(right).withColumn("event_time", F.timestamp_micros("ts_us"))
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("flight_id", "frame_id", "ts_us", "match_dt_us")]
        + [T.StructField(c, T.DoubleType()) for c in cols]
    )
    return (
        both.withWatermark("event_time", watermark)
        .groupBy("flight_id", "bucket")
        .transformWithStateInPandas(_Asof(tol_us, bucket_us, cols), schema, "Append", "EventTime")
    )


# ---------------------------------------------------------------- alerts


class _Cooldown(StatefulProcessor):
    def __init__(self, cooldown_us: int):
        self.cooldown_us = cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["ts_us", "frame_id"])
        t = pdf["ts_us"].to_numpy(dtype=np.int64)
        due = int(self.last.get()[0]) + self.cooldown_us if self.last.exists() else t[0]
        chosen = []
        at = int(np.searchsorted(t, due, side="left"))
        while at < len(t):
            chosen.append(at)
            at = int(np.searchsorted(t, t[at] + self.cooldown_us, side="left"))
        if chosen:
            self.last.update((int(t[chosen[-1]]),))
        yield pdf.iloc[chosen][["flight_id", "frame_id", "ts_us", "alert_msg"]]

    def close(self) -> None:
        pass


def cooldown(candidates: DataFrame, *, cooldown_us: int = C.ALERT_COOLDOWN_US) -> DataFrame:
    """Streaming ``alert_cooldown``. A flight's alerts must arrive in time order across
    micro-batches; one that is late never passes before an alert already sent."""
    schema = "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, alert_msg STRING"
    return (
        candidates.filter(F.coalesce(F.col("alert_msg"), F.lit("")) != "")
        .select("flight_id", "frame_id", "ts_us", "alert_msg")
        .groupBy("flight_id")
        .transformWithStateInPandas(_Cooldown(cooldown_us), schema, "Append", "None")
    )


def latest(alerts: DataFrame) -> DataFrame:
    """Most recent alert per flight; write it in ``update`` mode."""
    best = F.max_by(F.struct("frame_id", "ts_us", "alert_msg"), F.struct("ts_us", "frame_id"))
    return alerts.groupBy("flight_id").agg(best.alias("_a")).select("flight_id", "_a.*")


def sessions(
    events: DataFrame, *, key: str = "flight_id", gap: str = C.SESSION_GAP, watermark: str = "1 second"
) -> DataFrame:
    """Sessions that close after ``gap`` without activity, emitted once the watermark says so."""
    timed = events.withColumn("event_time", F.timestamp_micros("ts_us"))
    return (
        timed.withWatermark("event_time", watermark)
        .groupBy(key, F.session_window("event_time", gap).alias("_w"))
        .agg(F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("events"))
        .select(
            key, F.unix_micros("_w.start").alias("start_us"), "last_us", "events",
            F.unix_micros("_w.end").alias("close_us"),
        )
    )
