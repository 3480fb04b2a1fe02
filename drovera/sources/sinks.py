"""Alert sinks: JSON lines and a relational table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.alerts import iso_datetime


def alert_log_lines(alerts: DataFrame) -> DataFrame:
    """One JSON object per alert: frame_id, alert_msg, timestamp, datetime."""
    return alerts.select(
        F.to_json(
            F.struct(
                "frame_id",
                "alert_msg",
                (F.col("ts_us") / 1_000_000).alias("timestamp"),
                iso_datetime("ts_us").alias("datetime"),
            )
        ).alias("value")
    )


def write_dem_tiles(tiles: DataFrame, path: str) -> None:
    """Raster tiles in folders by raster and tile place, so that a reader opens only what it needs.

    A raster's tiles are dealt by place; each folder gets one file.
    """
    place = ("dem_id", "tile_row", "tile_col")
    tiles.repartition(*place).write.partitionBy(*place).mode("append").parquet(path)


def write_alert_log(alerts: DataFrame, path: str) -> None:
    alert_log_lines(alerts).write.mode("append").text(path)


def stream_alert_log(alerts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        alert_log_lines(alerts)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def alert_rows(payload: DataFrame) -> DataFrame:
    """Rows of the alerts table from viewer payloads; the image goes back to bytes."""
    return payload.select(
        "flight_id",
        "alert_msg",
        "frame_id",
        "timestamp",
        F.to_timestamp("datetime").alias("datetime"),
        F.unbase64("image").alias("image_data"),
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
    )


def new_alert_rows(rows: DataFrame, stored_keys: DataFrame | None) -> DataFrame:
    """One row per (flight, frame), without those already stored: a replayed batch adds nothing."""
    rows = rows.dropDuplicates(["flight_id", "frame_id"])
    if stored_keys is None:
        return rows
    return rows.join(stored_keys.select("flight_id", "frame_id"), ["flight_id", "frame_id"], "left_anti")


def write_alerts_jdbc(
    rows: DataFrame,
    url: str,
    *,
    table: str = "alerts",
    properties: Mapping[str, str] | None = None,
    skip_stored: bool = True,
) -> None:
    props = dict(properties or {})
    stored = None
    if skip_stored:
        # only keys of the batch's flights, in several pieces
        ends = rows.agg(F.min("flight_id"), F.max("flight_id")).first()
        if ends[0] is None:
            return
        keys = f"(SELECT flight_id, frame_id FROM {table}) k"
        stored = rows.sparkSession.read.jdbc(url, keys, predicates=key_predicates(*ends), properties=props)
    new_alert_rows(rows, stored).write.jdbc(url, table, mode="append", properties=props)


#: Stored keys are read in this many pieces.
KEY_PIECES = 16


def key_predicates(low: int, high: int, pieces: int = KEY_PIECES) -> list[str]:
    """Conditions that part the keys of flights low..high for a read by several tasks."""
    return [f"flight_id BETWEEN {int(low)} AND {int(high)} AND MOD(flight_id, {pieces}) = {k}" for k in range(pieces)]


def ledger_statements(table: str, epoch: int, stream: str, columns: Sequence[str]) -> list[str]:
    """SQL that publishes a staged batch exactly once, to be run in one transaction.

    ``<table>_staged`` holds rows with ``stream`` and ``epoch``; ``<table>_ledger`` names the batches that
    are in. A batch that is named there publishes nothing; its staged rows go either way. Of rows
    of one flight and frame the first message counts, and none that is stored is added again.
    """
    mine = f"stream = '{stream.replace(chr(39), chr(39) * 2)}' AND epoch = {int(epoch)}"
    listed = ", ".join(columns)
    return [
        f"""INSERT INTO {table} ({listed}) SELECT {listed} FROM (
          SELECT {listed}, row_number() OVER (PARTITION BY flight_id, frame_id ORDER BY alert_msg) AS place
          FROM {table}_staged WHERE {mine}) s
        WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM {table}_ledger WHERE {mine})
          AND NOT EXISTS (SELECT 1 FROM {table} t WHERE t.flight_id = s.flight_id AND t.frame_id = s.frame_id)""",
        f"INSERT INTO {table}_ledger (stream, epoch) SELECT '{stream.replace(chr(39), chr(39) * 2)}', {int(epoch)} "
        f"WHERE NOT EXISTS (SELECT 1 FROM {table}_ledger WHERE {mine})",
        f"DELETE FROM {table}_staged WHERE {mine}",
    ]


def ledger_batch_writer(
    url: str, stream: str, run: Callable[[list[str]], None], *, table: str = "alerts", properties: Mapping[str, str] | None = None
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch`` that stages a batch and then publishes it once.

    Tasks append to the staging table in parallel, where a retried task may leave rows twice. ``run``
    gets the statements that clear older remains before, and those that publish after, and runs each list in one
    transaction of the caller's connection.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        rows = alert_rows(batch)
        run([ledger_statements(table, epoch, stream, rows.columns)[-1]])
        staged = rows.withColumns({"stream": F.lit(stream), "epoch": F.lit(epoch).cast("bigint")})
        staged.write.jdbc(url, f"{table}_staged", mode="append", properties=dict(properties or {}))
        run(ledger_statements(table, epoch, stream, rows.columns))

    return write


def jdbc_batch_writer(
    url: str, *, table: str = "alerts", properties: Mapping[str, str] | None = None
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``."""

    def write(batch: DataFrame, _: int) -> None:
        write_alerts_jdbc(alert_rows(batch), url, table=table, properties=properties)

    return write
