"""Stages written to the shared folder, so that no later step recomputes or loses them."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from drovera.session import checkpoint_dir


#: Folders that the running step of a chain has staged, None outside steps; and what earlier steps left.
_open_step: list[str] | None = None
_left: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder of this application's stages."""
    folder = checkpoint_dir(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/drovera-llm/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    The files survive lost executors and give later plans real sizes. They stay until ``discard``
    or until the folder is cleared: a lazy result may still read them.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    if _open_step is not None:
        _open_step.append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _place(name: str) -> str:
    """A path without its scheme, as Spark and the setting may write it differently."""
    return "/" + name.partition(":")[2].lstrip("/") if ":/" in name else name


def _folders(df: DataFrame) -> set[str]:
    return {_place(f.rpartition("/")[0]) for f in df.inputFiles()}


def discard(*staged: DataFrame) -> None:
    """Delete the files of stages that no result read later depends on.

    Only folders that ``stage`` wrote for this application are touched; other inputs of a plan stay.
    """
    for df in staged:
        for folder in _folders(df):
            if folder.startswith(_place(root(df.sparkSession)) + "/"):
                _delete(df.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with memory to spare may not do
    for half an hour, while each plan's files stay on the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def chained(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A step of a chain whose results are written before the next step reads them.

    When the next step begins, what earlier steps staged is deleted, unless its ``docs`` read it: a
    caller that passes a result on unwritten loses nothing.
    """
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _open_step, _left
        read = _folders(docs)
        gone = [f for f in _left if _place(f) not in read]
        if not any(_place(f) in read for f in _left):
            for folder in gone:
                _delete(spark, folder)
            _left = []
        free_shuffles(spark)
        _open_step, outer = [], _open_step
        try:
            return step(spark, docs, sf_dir)
        finally:
            _left = _left + _open_step
            _open_step = outer

    run.__name__, run.__doc__ = step.__name__, step.__doc__
    return run
