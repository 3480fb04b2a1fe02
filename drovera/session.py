"""Session construction and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "drovera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; explicit ``conf`` entries win.

    Shuffle partitions start high and AQE coalesces them, so the same setting serves a laptop
    and a cluster; only local runs lower it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
        settings["spark.driver.host"] = "127.0.0.1"
        settings["spark.driver.bindAddress"] = "127.0.0.1"
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the session names.

    On a cluster it is only ever read from ``spark.checkpoint.dir``. A local run that names none
    gets a folder of its own; a cluster that names none gets None.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        return None
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    local = tempfile.mkdtemp(prefix="drovera-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut(df: DataFrame) -> DataFrame:
    """Materialise a stage that several later branches read, so none of them recomputes it.

    Uses a reliable checkpoint; on a cluster ``spark.checkpoint.dir`` must name its folder.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def sized(df: DataFrame) -> DataFrame:
    """Write a summary as Parquet under the checkpoint folder and read it back, so that its size is known.

    Spark takes a summary of a large table for large, and a join with it then shuffles the large
    table; with the true size its own check decides whether the summary is broadcast.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.rstrip('/')}/drovera-sized/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints of plans that nothing refers to any more.

    It does so when the driver's garbage is collected, which may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash rows over ``spark.sql.shuffle.partitions`` tasks before they multiply.

    Adaptive execution merges partitions by their size now; rows that each expand to hundreds
    (scan lines, circle rows) would then be expanded by a few tasks. A stated partition count is
    left alone by it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
