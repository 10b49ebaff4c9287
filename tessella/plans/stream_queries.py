"""Streams over the tables, run until all that is there has been taken up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import working_folder
from ..streaming import ingest, sessions
from .catalog import Tables, query
from .text_queries import NORM1, NORM2, VALID


@query("""WITH o AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, TRUE) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM o),
  g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, no)
  SELECT * FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def event_sessions(t: Tables) -> DataFrame:
    """The sessions that the watermark has closed by the end of the stream."""
    folder = working_folder(t.spark)
    stream = sessions.events_of(t.spark, t.stream_path("events"), t.events.schema)
    found = sessions.sessions(stream)
    sessions.kept(found, f"{folder}/sessions", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{folder}/sessions")


@query("""SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE FOR k IN range(4)]) AS start FROM events) GROUP BY ALL""")
def usage_sliding(t: Tables) -> DataFrame:
    """Overlapping windows of an hour, one every quarter."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.usage_windows(events, slide="15 minutes").select("start", "event_type", "n")


@query(f"""WITH n AS (SELECT doc_id, {NORM2} AS text FROM (SELECT doc_id, {NORM1} AS t1 FROM documents)), h AS (SELECT doc_id, md5(text) AS content_hash FROM n WHERE {VALID})
  SELECT min(doc_id) AS doc_id, content_hash FROM h GROUP BY content_hash""")
def ingested_documents(t: Tables) -> DataFrame:
    """What incremental ingestion of the documents leaves in a store."""
    folder = working_folder(t.spark)
    ingest.ingest_stream(t.spark, t.stream_path("documents"), t.documents.schema, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/store").select("doc_id", "content_hash")
