"""Alert texts, rate limiting, payloads, sessions and run-time summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import constants as C
from ..session import cut
from . import ordered as O


def anomaly_message(
    states: DataFrame, *, keys: Sequence[str] = ("flight_id", "frame_id"), out: str = "alert_msg",
    frames: DataFrame | None = None,
) -> DataFrame:
    """One line per frame naming the confirmed tracks that are visible in it, else empty.

    With ``frames`` every one of them has a line, also those without any state. They are stacked
    with the states and counted in one aggregation.
    """
    if frames is not None:
        states = states.unionByName(frames.select(*keys), allowMissingColumns=True)
    hit = F.col("state").startswith("confirmed")
    if "is_visible" in states.columns:
        hit = hit & F.col("is_visible")
    ids = F.array_sort(F.collect_list(F.when(hit, F.col("track_id"))))
    listed = states.groupBy(*keys).agg(ids.alias("_ids"))
    text = F.concat(F.lit("Anomaly: tracks ["), F.array_join(F.col("_ids").cast("array<string>"), ", "), F.lit("]"))
    return listed.withColumn(out, F.when(F.size("_ids") > 0, text).otherwise(F.lit(""))).drop("_ids")


# ---------------------------------------------------------------- cooldown


def _roots(ts: np.ndarray, cooldown: int) -> np.ndarray:
    """For every row, the last row the greedy rule reaches from it inside the block."""
    nxt = np.searchsorted(ts, ts + cooldown, side="left")
    hop = np.where(nxt < len(ts), nxt, np.arange(len(ts)))
    while True:
        far = hop[hop]
        if np.array_equal(far, hop):
            return hop
        hop = far


def alert_cooldown(
    df: DataFrame,
    *,
    cooldown_us: int = C.ALERT_COOLDOWN_US,
    keys: Sequence[str] = ("flight_id",),
    ts: str = "ts_us",
    order: str = "frame_id",
    message: str = "alert_msg",
    block_us: int | None = None,
    target_rows: int = O.TARGET_ROWS,
) -> DataFrame:
    """Greedy rate limit: an alert passes if at least ``cooldown_us`` went by since the last one
    that passed. Rows without a message neither pass nor count.

    The rule is sequential only through the time of the last alert. A block of time is therefore
    summarised by what it makes of that time: the few candidate first alerts inside the first
    cooldown, each with the last alert it leads to. The summaries are chained per flight (one row
    per block), and every block then lists its own alerts. All of these read the distinct alert
    times, which are therefore cut first.
    """
    keys = list(keys)
    candidates = df.filter(F.coalesce(F.col(message), F.lit("")) != "")
    # of several alerts at one instant only the first can pass
    points = cut(candidates.groupBy(*keys, ts).agg(F.min(order).alias("_o")))
    width = block_us or max(256 * cooldown_us, 600_000_000)
    blocked = O.time_blocks(points, keys, ts, width_us=width, target_rows=target_rows)

    key_fields = [df.schema[k] for k in keys]
    long = T.LongType()
    summary_type = T.StructType(
        [*key_fields, T.StructField(O.BLK, long),
         T.StructField("upto", T.ArrayType(long)), T.StructField("exit", T.ArrayType(long))]
    )
    entry_type = T.StructType(
        [*key_fields, T.StructField(O.BLK, long), T.StructField("_from", long)]
    )
    passed_type = T.StructType([*key_fields, T.StructField(ts, long)])

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[ts].to_numpy(dtype=np.int64))
        stop = min(int(np.searchsorted(t, t[0] + cooldown_us, side="left")), len(t) - 1)
        ends = t[_roots(t, cooldown_us)[: stop + 1]]
        last_of_run = np.append(np.nonzero(np.diff(ends))[0], stop)
        row = [*key, t[last_of_run].tolist(), ends[last_of_run].tolist()]
        return pd.DataFrame([row], columns=[*keys, O.BLK, "upto", "exit"])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(O.BLK)
        due = np.iinfo(np.int64).min
        entries = []
        for upto, ends in zip(pdf["upto"], pdf["exit"]):
            entries.append(due)
            at = int(np.searchsorted(np.asarray(upto), due, side="left"))
            if at < len(upto):
                due = int(ends[at]) + cooldown_us
        out = pdf[[*keys, O.BLK]].copy()
        out["_from"] = entries
        return out

    def emit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf[ts].to_numpy(dtype=np.int64))
        due = int(pdf["_from"].iloc[0])
        chosen = []
        at = int(np.searchsorted(t, due, side="left"))
        while at < len(t):
            chosen.append(int(t[at]))
            at = int(np.searchsorted(t, t[at] + cooldown_us, side="left"))
        out = pd.DataFrame({ts: np.asarray(chosen, dtype=np.int64)})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, ts]]

    entering = (
        blocked.groupBy(*keys, O.BLK)
        .applyInPandas(summarise, summary_type)
        .groupBy(*keys)
        .applyInPandas(chain, entry_type)
    )
    passed = (
        blocked.join(entering, [*keys, O.BLK])
        .groupBy(*keys, O.BLK)
        .applyInPandas(emit, passed_type)
    )
    winners = points.join(passed, [*keys, ts], "left_semi")
    return candidates.join(
        winners.withColumnRenamed("_o", order), [*keys, ts, order], "left_semi"
    ).select(*df.columns)


# ---------------------------------------------------------------- summaries


def latest_alert(
    alerts: DataFrame, *, keys: Sequence[str] = ("flight_id",), ts: str = "ts_us",
    order: str = "frame_id",
) -> DataFrame:
    """The most recent alert per flight, combined before the shuffle."""
    rest = [c for c in alerts.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(ts, order)).alias("_a")
    return alerts.groupBy(*keys).agg(best).select(*keys, "_a.*")


def alert_totals(alerts: DataFrame, *, keys: Sequence[str] = ("flight_id",)) -> DataFrame:
    return alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"))


def alerts_since(alerts: DataFrame, since_us: int | Column, *, ts: str = "ts_us") -> DataFrame:
    """What a viewer missed; a plain range predicate that reaches the scan."""
    return alerts.filter(F.col(ts) > (since_us if isinstance(since_us, Column) else F.lit(since_us)))


def stage_throughput(
    df: DataFrame,
    *,
    fps: int = C.FPS,
    keys: Sequence[str] = ("flight_id",),
    order: str = "frame_id",
    backlog: str = "backlog",
    seconds: str = "proc_s",
    block: int = O.SEQ_BLOCK,
) -> DataFrame:
    """Per run of ``fps`` processed frames: largest backlog, mean and largest processing time."""
    numbered = O.row_index(O.seq_blocks(df, order, size=block), keys, [order], "_n")
    return (
        numbered.withColumn("window_no", F.expr(f"(_n - 1) div {fps}"))
        .groupBy(*keys, "window_no")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.max(backlog).alias("backlog_max"),
            (F.avg(seconds) * 1000).alias("proc_avg_ms"),
            (F.max(seconds) * 1000).alias("proc_max_ms"),
        )
    )


def session_close(
    df: DataFrame,
    *,
    gap_us: int = 1_800_000_000,
    keys: Sequence[str] = ("flight_id",),
    ts: str = "ts_us",
    block_us: int = 86_400_000_000,
    target_rows: int = O.TARGET_ROWS,
) -> DataFrame:
    """Sessions of activity separated by at least ``gap_us`` of silence.

    Sessions are cut per block first; the pieces (at most one per gap length of time and one more
    per block) are then merged per key.
    """
    keys = list(keys)
    b = O.time_blocks(df.select(*keys, ts), keys, ts, width_us=block_us, target_rows=target_rows)
    w = O.block_window(keys, [ts])
    b = b.withColumn("_new", (F.col(ts) - F.lag(ts).over(w) >= gap_us).cast("int"))
    b = b.withColumn("_sid", F.sum(F.coalesce("_new", F.lit(0))).over(O.running(w)))
    parts = b.groupBy(*keys, O.BLK, "_sid").agg(
        F.min(ts).alias("_s"), F.max(ts).alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    wk = Window.partitionBy(*keys).orderBy("_s")
    fresh = F.coalesce((F.col("_s") - F.lag("_e").over(wk) >= gap_us).cast("int"), F.lit(0))
    parts = parts.withColumn("_fresh", fresh)
    parts = parts.withColumn("_id", F.sum("_fresh").over(O.running(wk)))
    return (
        parts.groupBy(*keys, "_id")
        .agg(F.min("_s").alias("start_us"), F.max("_e").alias("last_us"), F.sum("_n").alias("events"))
        .withColumn("close_us", F.col("last_us") + gap_us)
        .drop("_id")
    )


# ---------------------------------------------------------------- payload


def iso_datetime(ts_us: str | Column) -> Column:
    """ISO text of a microsecond epoch; whole seconds carry no fraction."""
    us = F.col(ts_us) if isinstance(ts_us, str) else ts_us
    at = F.timestamp_micros(us)
    return F.when(
        F.pmod(us, F.lit(1_000_000)) == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def alert_payload(
    alerts: DataFrame, *, image: str | None = "image", width: str = "orig_w", height: str = "orig_h"
) -> DataFrame:
    """The viewer message as columns: epoch seconds, ISO time and the image as base64 text.

    Join images to alerts after the cooldown, so that only forwarded frames move their bytes.
    """
    data = F.base64(F.col(image)) if image else F.lit(None).cast("string")
    return alerts.select(
        "flight_id",
        "frame_id",
        "alert_msg",
        (F.col("ts_us") / 1_000_000).alias("timestamp"),
        iso_datetime("ts_us").alias("datetime"),
        data.alias("image"),
        F.col(width).cast("int").alias("width"),
        F.col(height).cast("int").alias("height"),
        F.lit("jpeg").alias("compression"),
    )


def payload_json(payload: DataFrame, *, out: str = "value") -> DataFrame:
    return payload.select(
        F.to_json(F.struct(*[c for c in payload.columns if c != "flight_id"])).alias(out)
    )
