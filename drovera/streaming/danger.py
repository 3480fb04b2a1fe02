"""Live danger detection: frames, telemetry, detections and segments as one stream in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import alerts, spans, telemetry
from ..operators import ordered as O
from ..plans.danger import Covered, Ground, hazards
from ..session import cut, sized
from ..settings import Camera, HazardSettings
from .eventtime import EventTimeLog

FIELDS = tuple(C.TELEMETRY_TEMPLATE)
#: One row per frame, message, detection or segment; ``due_us`` is when the stream must have passed.
ROW = (
    "flight_id BIGINT, ts_us BIGINT, due_us BIGINT, kind STRING, frame_id BIGINT, seq BIGINT, topic STRING, payload STRING, "
    "cx INT, cy INT, x1 INT, x2 INT, y1 INT, y2 INT, class_id INT, y INT, x0 INT"
)
_CARRY = "flight_id BIGINT, kind STRING, id BIGINT, ts_us BIGINT, alert_msg STRING, " + ", ".join(f"{f} DOUBLE" for f in FIELDS)
_BOX = ("cx", "cy", "x1", "x2", "y1", "y2")
_SPAN = ("class_id", "y", "x0", "x1")


def inputs(
    frames: DataFrame, messages: DataFrame, detections: DataFrame, label_spans: DataFrame,
    *, tol_us: int = C.MATCH_TOLERANCE_US,
) -> DataFrame:
    """The four inputs stacked. Detections and segments carry the ``ts_us`` of their frame.

    A frame may match telemetry up to ``tol_us`` after it, so it is due that much later.
    """
    later = lambda df, kind: df.withColumns({"kind": F.lit(kind), "due_us": F.col("ts_us") + tol_us})
    parts = [
        later(frames.select("flight_id", "frame_id", "ts_us"), "frame"),
        messages.select("flight_id", "seq", "ts_us", "topic", "payload", F.lit("message").alias("kind"), F.col("ts_us").alias("due_us")),
        later(detections.select("flight_id", "frame_id", "ts_us", *_BOX), "box"),
        later(label_spans.select("flight_id", "frame_id", "ts_us", *_SPAN), "segment"),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    fields = [f.strip().split(" ") for f in ROW.split(",")]
    return stacked.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def danger_log(
    folder: str, ground: Ground | None, *, delay_us: int, ttl_us: int | None = None, camera: Camera = Camera(),
    settings: HazardSettings = HazardSettings(), width: int = C.PROCESSING_SHAPE[0], height: int = C.PROCESSING_SHAPE[1],
) -> EventTimeLog:
    """``danger_detection`` over a stream of ``inputs``: flags of every frame, ``alerted`` where its alert passed.

    Frames are judged once the watermark has passed everything that can match them, by the batch
    job itself. Carried per flight: the snapshots that later frames may match, of which the last
    also starts the next fill, and the last alert that passed. The ground is prepared once, and what it covers
    of a frame is counted once for a pose that batch after batch has.
    """
    tol = settings.tolerance_us
    names = [n for n, _ in C.DANGER_LABELS]
    out = "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, " + ", ".join(f"{n} BOOLEAN" for n in names)
    out += ", intersection_px BIGINT, danger_px BIGINT, alert_msg STRING, alerted BOOLEAN"

    cover = None if ground is None else Covered(ground)

    def finish(ready: DataFrame, carry: DataFrame) -> tuple[DataFrame, DataFrame]:
        # Parquet, of which each kind of row reads its own columns
        ready, carry = sized(ready), sized(carry)
        kind = lambda name, *cols: ready.filter(F.col("kind") == name).select("flight_id", *cols)
        old = carry.filter("kind = 'snapshot'").select("flight_id", F.col("id").alias("seq"), "ts_us", *FIELDS)
        decoded = telemetry.decode_telemetry(kind("message", "seq", "ts_us", "topic", "payload"))
        own = {f: F.when(F.col("field") == f, F.col("value")) for f in FIELDS}
        filled = O.running_last(O.seq_blocks(decoded, "seq"), ["flight_id"], "seq", own)
        last = old.groupBy("flight_id").agg(*[F.max_by(f, "seq").alias(f"_c_{f}") for f in FIELDS])
        new = filled.join(last, "flight_id", "left").select(
            "flight_id", "seq", "ts_us",
            *[F.coalesce(F.col(f), F.col(f"_c_{f}"), F.lit(float(v))).alias(f) for f, v in C.TELEMETRY_TEMPLATE.items()],
        )
        snaps = cut(old.unionByName(new))
        found = hazards(
            kind("frame", "frame_id", "ts_us"), snaps, kind("box", "frame_id", *_BOX), kind("segment", "frame_id", *_SPAN),
            ground=ground, camera=camera, settings=settings, width=width, height=height, cover=cover,
        )
        before = carry.filter("kind = 'alert'").select("flight_id", F.col("id").alias("frame_id"), "alert_msg", "ts_us")
        hits = found.flags.filter("alert_msg <> ''").select(*spans.FRAME, "alert_msg", "ts_us")
        passed = cut(alerts.alert_cooldown(hits.unionByName(before), cooldown_us=settings.cooldown_us).select(*hits.columns))
        marked = passed.select(*spans.FRAME, F.lit(True).alias("alerted"))
        rows = found.flags.join(marked, list(spans.FRAME), "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
        # what is due next lies at or after the latest row that is final now
        edge = ready.groupBy("flight_id").agg((F.max("due_us") - 2 * tol).alias("_edge"))
        newest = snaps.groupBy("flight_id").agg(F.max("seq").alias("_newest"))
        kept = snaps.join(newest, "flight_id").join(edge, "flight_id", "left").filter(
            (F.col("seq") == F.col("_newest")) | F.col("_edge").isNull() | (F.col("ts_us") >= F.col("_edge"))
        )
        last_alert = F.max_by(F.struct("frame_id", "ts_us", "alert_msg"), F.struct("ts_us", "frame_id")).alias("_a")
        sent = passed.groupBy("flight_id").agg(last_alert).select(
            "flight_id", F.lit("alert").alias("kind"), F.col("_a.frame_id").alias("id"), "_a.ts_us", "_a.alert_msg"
        )
        snapshots = kept.select("flight_id", F.lit("snapshot").alias("kind"), F.col("seq").alias("id"), "ts_us", *FIELDS)
        columns = [f.strip().split(" ")[0] for f in out.split(",")]
        return rows.select(*columns), snapshots.unionByName(sent, allowMissingColumns=True)

    return EventTimeLog(
        folder, finish, row_schema=ROW, carry_schema=_CARRY, out_schema=out, delay_us=delay_us, ttl_us=ttl_us, ts="due_us"
    )
