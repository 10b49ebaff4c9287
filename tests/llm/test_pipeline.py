"""The pipeline's stages by name and order, and their rows on a small folder."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    passage, copy = prose(70), prose(120)
    rows = [(i, f"{prose(80)}.", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, copy, "en", "s0"), (101, copy, "en", "s1"), (102, copy + " more", "en", "s1")]
    rows += [(110, f"{prose(40)} {passage}", "en", "s0"), (111, f"{passage} {prose(40)}", "en", "s2"), (120, prose(30) + " u1@mail.example.com " + prose(30), "en", "s0")]
    rows += [(200 + i, f"{prose(30)}. you awfulword {prose(3)}.", "en", "s1") for i in range(40)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "personal_data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = set(range(60)) | {100, 110, 111, 120}
    assert set(seen["toxicity"]) == clean | {101, 102}
    assert set(seen["near_duplicates"]) == clean
    assert len(seen["repeats"][111]["text"].split()) == 40 and seen["repeats"][111]["n_chars"] == len(seen["repeats"][111]["text"])
    assert "[EMAIL]" in seen["personal_data"][120]["text"] and seen["personal_data"][0]["text"] == seen["repeats"][0]["text"]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == clean
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


ODD = "doc_id long, text string, lang string, source string, n_chars long, rep string, hub int, component int, __n int, term string, score double, block int, z string"


def odd_rows():
    r = random.Random(8)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    long, same = prose(30_000), prose(50)
    texts = [(1, None), (2, ""), (3, " \n"), (None, same), (None, None), (5, same), (5, same), (6, same), (7, long), (8, "x" * 100_000), (9, prose(60)), (9, prose(60)), (10, "one")]
    return [(i, t, None, None if k % 2 else "s", None, "r", 1, 2, 3, "t", 0.5, 4, "z") for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("with_labels", [True, False])
def test_stages_on_odd_and_empty_tables(spark, tmp_path, with_labels):
    labels = [(9, 1, 0), (None, None, None), (2, None, None), (2, 0, 0)] if with_labels else []
    for name, rows in (("odd", odd_rows()), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, ODD).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        seen = {}
        for stage, function in corpus_pipeline.STAGES[:-1]:
            docs = function(spark, docs, folder).cache()
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in spark.read.parquet(f"{folder}/documents.parquet").schema]
            seen[stage] = docs.collect()
        assert len(seen["toxicity"]) == len(rows)  # no evidence, none goes
        if not rows:
            assert corpus_pipeline.run(spark, folder).count() == 0
            continue
        kept = sorted(str(x["doc_id"]) for x in seen["near_duplicates"])
        assert kept == sorted(["1", "2", "3", "None", "None", "5", "5", "7", "8", "9", "9", "10"])  # 6 is a copy of 5; one doc_id is one document
        assert len(seen["repeats"]) == len(seen["personal_data"]) == len(kept)
        assert [x["text"] for x in seen["personal_data"] if x["doc_id"] == 1] == [None]
        packed = corpus_pipeline.run(spark, folder).collect()
        assert sum(x["length"] for x in packed if x["doc_id"] == 2) == 1 and max(x["offset"] + x["length"] for x in packed) <= 2048
