"""The vector index against brute force: recall, exactness when all is probed, what is read, odd tables."""

import contextlib
import io

import numpy as np
import pytest

from tessella.operators import search
from tessella.operators import vector_index as V
from tessella.sources.scratch import working_folder

VECTORS, QUERIES = "vec_id long, embedding array<float>", "query_id long, query_vector array<float>"


def made(n, width=16, seed=1):
    r = np.random.default_rng(seed)
    return (r.standard_normal((40, width))[r.integers(40, size=n)] * 0.6 + r.standard_normal((n, width)) * 0.25).astype(np.float32)


@pytest.fixture(scope="module")
def tables(spark):
    x = made(3000)
    x[500:900] = x[7]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [1.0, None] * 8), (5002, [float("nan")] * 16), (5003, [1.0] * 3)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3).cache()
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if i % 20 == 0] + [(9000, None), (9001, [1.0])], QUERIES).cache()
    return vectors, queries


def rows(df):
    return sorted((r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
def test_recall_and_scores(spark, tables, metric, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 150)  # cells of several slices
    monkeypatch.setattr(V, "QUERIES", 60)
    vectors, queries = tables
    sound = vectors.where("vec_id < 5000")
    asked = queries.where("query_id < 9000")
    exact = search.nearest(sound, asked, 5, metric, None)
    index = V.VectorIndex.build(vectors, working_folder(spark), metric)
    assert index.rows().count() == 3000 and len(index.shape.centroids) > 30
    found = index.search(queries, 5, None)
    assert V.recall(found, exact).first()["recall"] >= 0.95
    scores = {(q, v): s for q, v, s, _ in rows(search.nearest(sound, asked, 400, metric, None, most=400))}
    assert all(abs(scores[q, v] - s) < 1e-5 for q, v, s, _ in rows(found) if (q, v) in scores)
    everything = V.VectorIndex.open(spark, index.folder).search(queries, 5, None, probes=10**6, refine=700)
    assert [(q, round(s, 5), k) for q, _, s, k in rows(everything)] == [(q, round(s, 5), k) for q, _, s, k in rows(exact)]


def test_only_probed_cells_are_read(spark, tables):
    vectors, queries = tables
    index = V.VectorIndex.build(vectors, working_folder(spark))
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        index.search(queries.where("query_id = 20"), 5, probes=2).explain("formatted")
    filters = [line for line in said.getvalue().splitlines() if "PartitionFilters" in line and "cell" in line]
    assert filters and all("cell" in f and ("IN (" in f or " IN " in f or "= " in f) for f in filters)
    assert [r["vec_id"] for r in index.search(queries.where("query_id = 20"), 1, probes=1).collect()] == [20]


def test_odd_tables(spark):
    queries = spark.createDataFrame([(1, [0.0, 1.0])], QUERIES)
    for given in ([], [(1, None)]):
        assert V.VectorIndex.build(spark.createDataFrame(given, VECTORS), working_folder(spark)).search(queries).collect() == []
    index = V.VectorIndex.build(spark.createDataFrame([(3, [0.0, 1.0]), (2, [0.0, 1.0]), (9, [5.0, 5.0])], VECTORS), working_folder(spark))
    assert [(r["vec_id"], r["score"]) for r in sorted(index.search(queries).collect(), key=lambda r: r["rank"])] == [(2, 1.0), (3, 1.0)]
    with pytest.raises(ValueError):
        V.VectorIndex.build(spark.createDataFrame([], VECTORS), working_folder(spark), "ip")


def test_codes_are_near():
    x = made(2000, 12, 4)
    shape = V.Shape(x.astype(np.float64), 2000)
    cell, codes = shape.place(x.astype(np.float64))
    for c in np.unique(cell)[:10]:
        about, exact = shape.near(x[0].astype(np.float64), int(c), codes[cell == c]), ((x[cell == c] - x[0]) ** 2).sum(axis=1)
        assert np.abs(about - exact).mean() < 0.5 * exact.mean() + 0.1
