"""The store and the cache: additions, changes, deletions, failures in between, and what is embedded."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.embedding import hash_embedder
from tessella.sources.scratch import working_folder
from tessella.sources.vector_store import EmbeddingCache, VectorStore

ROWS = "id long, text string"


def held(store):
    return sorted((r["id"], r["text"]) for r in store.rows().collect())


def test_rows_come_change_and_go(spark):
    store = VectorStore(spark, working_folder(spark), buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    assert store.rows() is None
    store.delete(frame([(1, "")]))
    store.upsert(frame([]))
    store.upsert(frame([(k, f"t{k}") for k in range(30)] + [(None, "none")]))
    assert held(store) == [(k, f"t{k}") for k in range(30)]
    store.upsert(frame([(3, "new"), (40, "t40")]))
    before = store.versions()
    store.delete(frame([(5, ""), (999, "")]))
    after = store.versions()
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket was written anew
    want = sorted([(k, "new" if k == 3 else f"t{k}") for k in range(30) if k != 5] + [(40, "t40")])
    assert held(store) == want
    store.vacuum()
    assert held(VectorStore(spark, store.folder, buckets=4)) == want
    store.delete(frame(want))
    assert held(store) == []
    store.upsert(frame([(1, "again")]))
    assert held(store) == [(1, "again")]


def test_a_change_that_fails_is_not_seen(spark):
    store = VectorStore(spark, working_folder(spark), buckets=2)
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], ROWS))
    broken = spark.createDataFrame([(1, "x"), (3, "y")], ROWS).withColumn("text", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken)
    assert held(store) == [(1, "a"), (2, "b")]


def test_each_text_is_embedded_once(spark):
    folder, embed = working_folder(spark), hash_embedder(8)
    texts = spark.createDataFrame([(1, "a text"), (2, "a text"), (3, "other words"), (4, None), (5, " ")], ROWS)
    first = EmbeddingCache(spark, folder, "m", embed)
    out = {r["id"]: r["vector"] for r in first.vectors(texts).collect()}
    assert first.embedded == 3 and out[1] == out[2] and out[4] is None and out[5] == []
    direct = {r["id"]: r["v"] for r in texts.where("text IS NOT NULL").select("id", embed(F.col("text")).alias("v")).collect()}
    assert {i: v for i, v in out.items() if i != 4} == direct
    again = EmbeddingCache(spark, folder, "m", embed)
    more = again.vectors(texts.unionByName(spark.createDataFrame([(6, "new words here")], ROWS)))
    assert {r["id"]: r["vector"] for r in more.collect() if r["id"] != 6} == out and again.embedded == 1
    other = EmbeddingCache(spark, folder, "another model", embed)
    other.vectors(texts).collect()
    assert other.embedded == 3
