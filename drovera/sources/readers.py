"""Batch and streaming sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.tiles import TILE


def _read(spark: SparkSession, path: str, schema: str, streaming: bool, fmt: str) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(fmt).load(path)


def read_telemetry_messages(
    spark: SparkSession, path: str, *, streaming: bool = False, fmt: str = "parquet"
) -> DataFrame:
    """Topic/payload messages; ``ts_us`` is the arrival time."""
    return _read(spark, path, schemas.TELEMETRY_MESSAGES, streaming, fmt)


def telemetry_from_kafka(kafka: DataFrame) -> DataFrame:
    """Shape rows of a Kafka source into telemetry messages.

    One Kafka topic carries the telemetry of all flights with the flight id as key, so a flight
    lies in one partition and the offset orders it without repeats. The message topic travels in
    the header ``topic`` (a Kafka topic name cannot hold its slashes); read the source with
    ``includeHeaders``. Records without that header keep a null topic and drop out on decoding.
    """
    if "headers" not in kafka.columns:
        raise ValueError("read the Kafka source with includeHeaders=true")
    named = F.filter("headers", lambda h: h["key"] == "topic")
    return kafka.select(
        F.col("key").cast("string").try_cast("bigint").alias("flight_id"),
        F.col("offset").alias("seq"),
        F.unix_micros("timestamp").alias("ts_us"),
        F.get(named, F.lit(0))["value"].cast("string").alias("topic"),
        F.col("value").cast("string").alias("payload"),
    )


def read_frames(
    spark: SparkSession, path: str, *, streaming: bool = False, fmt: str = "parquet"
) -> DataFrame:
    """Frame manifest. Ids count read attempts, so they rise but have gaps."""
    return _read(spark, path, schemas.FRAMES, streaming, fmt)


def read_dem_cells(
    spark: SparkSession, elevation_path: str | None, mask_path: str | None = None
) -> DataFrame | None:
    """Elevation cells with their nodata mask.

    No elevation table means no raster at all; no mask means every cell is valid. A mask without
    elevation is ignored.
    """
    if elevation_path is None or not _exists(spark, elevation_path):
        return None
    elev = spark.read.schema("dem_id STRING, row INT, col INT, elev DOUBLE").parquet(elevation_path)
    if mask_path is None or not _exists(spark, mask_path):
        return elev.withColumn("nodata", F.lit(0))
    mask = spark.read.schema("dem_id STRING, row INT, col INT, nodata INT").parquet(mask_path)
    return elev.join(mask, ["dem_id", "row", "col"], "left").withColumn(
        "nodata", F.coalesce("nodata", F.lit(0))
    )


def read_dem_tiles(
    spark: SparkSession, path: str, *, values: str = "elev array<double>, nodata array<int>",
    rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, tile: int = TILE,
) -> DataFrame:
    """Tiles written by ``write_dem_tiles``; given cell rows and columns, only the files that hold them.

    Joined by ``(dem_id, tile_row, tile_col)``, files of tiles that no row asks for are pruned while
    the query runs.
    """
    schema = f"{values}, dem_id STRING, tile_row INT, tile_col INT"
    tiles = spark.read.schema(schema).parquet(path)
    for name, ends in (("tile_row", rows), ("tile_col", cols)):
        if ends is not None:
            tiles = tiles.filter(F.col(name).between(ends[0] // tile, ends[1] // tile))
    return tiles


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# patterns of the text log
_NUM = r"(-?\d+(?:\.\d+)?)"


def parse_flight_log(blocks: DataFrame, *, text: str = "value") -> DataFrame:
    """One row per record of a subtitle-style flight log."""

    def grab(pattern: str, kind: str) -> F.Column:
        return F.regexp_extract(F.col(text), pattern, 1).try_cast(kind)

    rows = blocks.select(
        grab(r"FrameCnt: (\d+)", "bigint").alias("frame_cnt"),
        grab(r"DiffTime: (\d+)ms", "int").alias("diff_ms"),
        grab(r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)", "timestamp").alias("wall_ts"),
        *[
            grab(rf"{name}: {_NUM}", "double").alias(name)
            for name in (
                "latitude", "longitude", "rel_alt", "abs_alt", "gb_yaw", "gb_pitch", "gb_roll"
            )
        ],
    )
    return rows.filter(F.col("frame_cnt").isNotNull())


def read_flight_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a flight log, whatever its line ends and blank lines look like.

    Every record has one arrow, between the two times it covers; all fields stand after it. Cut at the
    arrows, a piece holds one record's fields and the number and start of the next, which are not
    read, so Spark may split large logs anywhere.
    """
    return parse_flight_log(spark.read.text(path, lineSep="-->"))
