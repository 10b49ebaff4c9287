"""Table functions against the DataFrame operators."""

import random

from pyspark.sql import functions as F

from tessella.functions.text import boundary_clean
from tessella.operators import prepare
from tessella.plans import registry
from tessella.sources import table_functions


def test_cleaning_equals_the_column(spark):
    r = random.Random(1)
    bits = ["...", "ab ", "a", "Word ", " ", "\n", "\t", "é", "Éa ", "word", ". ", ",", "?!", "x) ", "ß", "1", "_", " ", "“q” "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(1500)]
    out = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", boundary_clean(F.col("t")).alias("c")).collect()
    assert {x["i"]: x["c"] for x in out} == {i: table_functions.cleaned(t) for i, t in enumerate(texts)}


def test_chunks_from_sql(spark):
    rows = lambda df: sorted((x["doc_id"], x["chunk_index"], x["chunk_total"], x["chunk"]) for x in df.collect())
    assert rows(registry.queries()["sql_chunks"](spark, "/root/testdata/sf0.001")) == rows(registry.queries()["recursive_chunks"](spark, "/root/testdata/sf0.001"))
    given = spark.createDataFrame([(1, None), (2, " "), (3, "one two. " * 200)], "doc_id long, text string")
    given.createOrReplaceTempView("given_texts")
    got = spark.sql("SELECT doc_id, c.* FROM given_texts, LATERAL chunk_text(text, 100, 20, 50) c")
    assert rows(got) == rows(prepare.chunks(given, 100, 20, 50)) and {x["doc_id"] for x in got.collect()} == {3}
