"""Incremental ingestion: new files of a folder are normalised, checked, deduplicated and appended to a store.

A file source with a checkpoint reads each file once, also after a restart. Each micro-batch drops what the store already
has (of the store only the column of content hashes is read, and only those that the batch has are joined) and what it repeats itself, and appends the rest under its batch number, so that a
batch that is run again overwrites its own rows and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import is_valid, normalize
from ..sources.scratch import dealt, settled


def prepared(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with the stored text and its hash; invalid texts go. Written before it is filtered: a filter on
    the normalised text would have it normalised once more."""
    ready = dealt(docs, "doc_id").withColumn("text", normalize(normalize(F.col("text"))))
    ready = settled(ready.withColumns({"content_hash": F.md5(F.col("text").cast("binary")), "__valid": is_valid(F.col("text"))}))
    return ready.where("__valid").drop("__valid")


def append_new(batch: DataFrame, number: int, store: str) -> None:
    """One micro-batch into the store."""
    spark = batch.sparkSession
    ready = prepared(batch)
    first = settled(ready.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")))
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        stored = spark.read.parquet(store).where(F.col("batch") != number).select("content_hash")
        known = stored.join(first.select("content_hash"), "content_hash", "left_semi").distinct()  # a small batch's hashes go to the store's, not these to it
        first = settled(first.join(known, "content_hash", "left_anti"))
    new = ready.join(first.hint("shuffle_hash"), ["content_hash", "doc_id"], "left_semi")  # texts pass by, they are not sorted
    new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)


def ingest_stream(spark: SparkSession, folder: str, schema: StructType, store: str, checkpoint: str) -> StreamingQuery:
    """Takes up all files that are there now, and ends; call again for later ones."""
    files = spark.readStream.schema(schema).parquet(folder)
    return files.writeStream.foreachBatch(lambda df, n: append_new(df, n, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """events (ts, event_type, user_id), a stream or a table: counts and approximate users of each window and type.

    Windows follow each other, or begin every `slide` and overlap.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "n", "users")
