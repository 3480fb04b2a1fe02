"""Run a stream over everything that is there and keep the result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder."""
    base = checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input, in append mode, and return what was written."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_updates(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in update mode; every changed row of every batch, with its ``batch``."""
    spark = stream.sparkSession
    folder = scratch(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
