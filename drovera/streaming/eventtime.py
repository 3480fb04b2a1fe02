"""Event-time operators whose state is tables: watermarks, late rows and expiry per flight.

Every micro-batch runs batch operators over the rows that have become final, beside the carry rows
that earlier batches left (one per flight), so a flight with a third of all rows is spread over
tasks as in the batch job and no group is held in one worker. All tables of a batch go to folders
named by its number: a batch that is replayed after a failure overwrites its own and reads those of
the batch before.

A flight's watermark is its latest event time less ``delay_us``, as of the batches before. Rows behind it
are late and go to a side table. Rows the watermark has not passed wait as pending. A flight without
rows for ``ttl_us`` of the stream's time is closed: what is pending is finished and its state is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import alerts
from ..operators import ordered as O

Finish = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class EventTimeResult:
    """Tables of a drained stream; each has the number of its batch as ``epoch``."""

    rows: DataFrame  # what the operator made of the rows on time
    late: DataFrame  # rows behind their flight's watermark, as they came
    closed: DataFrame  # flight_id, last_us: flights that expired

    def late_counts(self) -> DataFrame:
        """Late rows per flight."""
        return self.late.groupBy("flight_id").agg(F.count(F.lit(1)).alias("late_rows"))


class EventTimeLog:
    """Runs ``finish(ready, carry) -> (rows, carry)`` over a stream in event time.

    ``ready`` are rows no later row can precede, ``carry`` is what the last call returned, one row
    per flight, without flights that were closed.
    """

    def __init__(
        self, folder: str, finish: Finish, *, row_schema: str, carry_schema: str, out_schema: str,
        delay_us: int, ttl_us: int | None = None, ts: str = "ts_us",
    ) -> None:
        self.folder, self.finish, self.ts = folder.rstrip("/"), finish, ts
        self.delay_us, self.ttl_us = delay_us, ttl_us
        self.schemas = {
            "pending": row_schema, "late": row_schema, "carry": carry_schema, "rows": out_schema,
            "marks": f"flight_id BIGINT, {ts} BIGINT", "closed": "flight_id BIGINT, last_us BIGINT",
        }

    def _write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def _before(self, spark: SparkSession, name: str, epoch: int) -> DataFrame:
        """State the batch before left; none before the first."""
        if epoch == 0:
            return spark.createDataFrame([], self.schemas[name])
        return spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/epoch={epoch - 1}")

    def batch(self, rows: DataFrame, epoch: int, *, flush: bool = False) -> None:
        """One micro-batch; ``flush`` finishes everything that is pending."""
        spark, ts = rows.sparkSession, F.col(self.ts)
        marks = self._before(spark, "marks", epoch)
        known = marks.select("flight_id", (ts - self.delay_us).alias("_mark"))
        judged = rows.join(known, "flight_id", "left").withColumn("_late", F.coalesce(ts < F.col("_mark"), F.lit(False)))
        self._write(judged.filter("_late").select(*rows.columns), "late", epoch)
        # maxima combine before the shuffle, so a hot flight sends one row a task
        latest = marks.unionByName(rows.groupBy("flight_id").agg(F.max(ts).alias(self.ts))).groupBy("flight_id").agg(F.max(ts).alias(self.ts))
        clock = latest.agg(F.max(ts)).first()[0]
        gone = F.lit(False) if self.ttl_us is None or clock is None else ts < clock - self.ttl_us
        self._write(latest.filter(gone).select("flight_id", ts.alias("last_us")), "closed", epoch)
        self._write(latest.filter(~gone), "marks", epoch)
        limit = latest.select("flight_id", F.when(gone | F.lit(flush), F.lit(2**63 - 1)).otherwise(ts - self.delay_us).alias("_mark"))
        held = judged.filter("not _late").select(*rows.columns).unionByName(self._before(spark, "pending", epoch))
        held = held.join(limit, "flight_id")
        self._write(held.filter(ts >= F.col("_mark")).drop("_mark"), "pending", epoch)
        out, carry = self.finish(held.filter(ts < F.col("_mark")).drop("_mark"), self._before(spark, "carry", epoch))
        self._write(out, "rows", epoch)
        closed = spark.read.schema(self.schemas["closed"]).parquet(f"{self.folder}/closed/epoch={epoch}")
        self._write(carry.join(closed, "flight_id", "left_anti"), "carry", epoch)

    def drain(self, stream: DataFrame) -> EventTimeResult:
        """Process all that is there, finish what is pending at its end, and return the tables."""
        spark, last = stream.sparkSession, [-1]

        def each(rows: DataFrame, epoch: int) -> None:
            self.batch(rows, epoch)
            last[0] = epoch

        query = (
            stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        self.batch(spark.createDataFrame([], stream.schema), last[0] + 1, flush=True)
        return self.tables(spark)

    def tables(self, spark: SparkSession) -> EventTimeResult:
        """What all batches so far have written."""
        read = lambda name: spark.read.schema(f"{self.schemas[name]}, epoch INT").parquet(f"{self.folder}/{name}")
        return EventTimeResult(read("rows"), read("late"), read("closed"))


def snapshot_log(
    folder: str, *, template: Mapping[str, float] = C.TELEMETRY_TEMPLATE, delay_us: int, ttl_us: int | None = None
) -> EventTimeLog:
    """``telemetry_snapshot`` of decoded messages in event time, whatever order they arrive in.

    ``seq`` is the sender's number and rises with time. A flight that was closed starts again from the
    template.
    """
    fields = ", ".join(f"{f} DOUBLE" for f in template)
    out = f"flight_id BIGINT, seq BIGINT, ts_us BIGINT, {fields}"

    def finish(ready: DataFrame, carry: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = {f: F.when(F.col("field") == f, F.col("value")) for f in template}
        filled = O.running_last(O.seq_blocks(ready, "seq"), ["flight_id"], "seq", own)
        old = carry.select("flight_id", *[F.col(f).alias(f"_c_{f}") for f in template])
        value = lambda f, v: F.coalesce(F.col(f), F.col(f"_c_{f}"), F.lit(float(v))).alias(f)
        rows = filled.join(old, "flight_id", "left").select(
            "flight_id", "seq", "ts_us", *[value(f, v) for f, v in template.items()]
        )
        newest = F.max_by(F.struct("seq", "ts_us", *template), "seq").alias("_r")
        return rows, carry.unionByName(rows).groupBy("flight_id").agg(newest).select("flight_id", "_r.*")

    return EventTimeLog(
        folder, finish, row_schema="flight_id BIGINT, seq BIGINT, ts_us BIGINT, field STRING, value DOUBLE",
        carry_schema=out, out_schema=out, delay_us=delay_us, ttl_us=ttl_us,
    )


def cooldown_log(
    folder: str, *, cooldown_us: int = C.ALERT_COOLDOWN_US, delay_us: int, ttl_us: int | None = None
) -> EventTimeLog:
    """``alert_cooldown`` in event time; the last alert that passed is carried, and forgotten when a flight closes."""
    schema = "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, alert_msg STRING"

    def finish(ready: DataFrame, carry: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = ready.filter(F.coalesce(F.col("alert_msg"), F.lit("")) != "")
        # the carried alert stands before all ready ones, so it passes again and is then left out
        passed = alerts.alert_cooldown(named.unionByName(carry), cooldown_us=cooldown_us)
        passed = passed.select("flight_id", "frame_id", "ts_us", "alert_msg")
        rows = passed.join(carry, ["flight_id", "frame_id", "ts_us"], "left_anti")
        last = F.max_by(F.struct("frame_id", "ts_us", "alert_msg"), F.struct("ts_us", "frame_id")).alias("_r")
        return rows, passed.groupBy("flight_id").agg(last).select("flight_id", "_r.*")

    return EventTimeLog(
        folder, finish, row_schema=schema, carry_schema=schema, out_schema=schema, delay_us=delay_us, ttl_us=ttl_us
    )
