"""Folders for tables and files that a plan writes on its way; they go when the session's program ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: list[tuple[SparkSession, str]] = []


def working_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in spark.checkpoint.dir; of this machine only where all of Spark runs in it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: files need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-files-")
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _folders.append((spark, folder))
    return folder


def settled(df: DataFrame) -> DataFrame:
    """df computed once for several uses: written out and read again, so that lost executors cost no more than a read."""
    folder = working_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows dealt to tasks by keys, however the table's files are cut: for work that takes longer than moving its rows."""
    return df.hint("rebalance", *keys)


@atexit.register
def _sweep() -> None:
    for spark, folder in _folders:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder goes with the cluster's own cleaning
            return
