"""Stateful streams: sessions, events told once, and the sink that keeps each row once, also after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def events_of(spark: SparkSession, path: str, schema: StructType, at_once: int = 1000) -> DataFrame:
    """The files of a path as a stream, at most so many a batch; ts is an instant, whatever clock it was written with."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """events (ts, user_id, value), a stream or a table: (user_id, start, end, n, total) of each user's sessions.

    A session ends when nothing follows for the gap; its end is the last event and the gap. Of a stream, a session is told once the
    watermark has passed its end, and its state goes; events that are later than `late` are dropped. Of a table all sessions are told.
    Rows without ts belong to no session; those without user_id are a user.
    """
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def told_once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """A stream without events that repeat the keys of one that is no older than `late`; state older than that goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def kept(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to a folder, takes up all that is there now, and ends; call again for later files.

    The folder's log names the files of each batch: a batch that is run again after a failure replaces its own rows.
    """
    return stream.writeStream.format("parquet").outputMode("append").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
