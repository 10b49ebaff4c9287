"""An approximate vector index: cells around trained centroids, residual codes, exact scores of the best.

build() fits centroids and codebooks on a bounded sample (SAMPLE rows, those with the smallest hash of their ids), then places every
row: its nearest centroid is its cell, and what is left of it is coded as the nearest entry of a codebook for each of PARTS parts.
Rows are written by cell; a cell with many rows, copies for example, is cut into slices of about SLICE rows, so that no task
ever holds a cell as a whole.

search() looks into the PROBES cells nearest to each query. A slice's codes are compared with the queries that probe it by tables of
distances between the query's residual and the codebooks' entries; each slice returns the best of each query. The vectors of the best
REFINE * k are read then, and scored exactly as in the brute-force search. Other cells are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import settled
from .search import PLACES, score_of, top

#: Rows that centroids and codebooks are fitted on at most.
SAMPLE = 20_000
PARTS, ENTRIES, ROUNDS = 8, 32, 12
#: Rows of the sample that a cell has on average at least.
PER_CELL = 32
SLICE = 20_000
#: Queries that meet a slice in one group.
QUERIES = 2000
PROBES, REFINE = 12, 10
SEED = 3


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """At most k centroids of the rows of x by Lloyd's rounds; the first ones are far apart from each other."""
    r = np.random.default_rng([seed, k])
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    chosen = [int(r.integers(len(x)))]
    apart = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and apart.sum() > 0:
        chosen.append(int(r.choice(len(x), p=apart / apart.sum())))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centroids = x[chosen]
    for _ in range(rounds):
        at = closest(x, centroids)
        total, n = np.zeros_like(centroids), np.bincount(at, minlength=len(centroids))
        np.add.at(total, at, x)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * (x @ centroids.T)


def closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centroids).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Shape:
    """What a search needs beside the rows: centroids, and a codebook for each part of the residuals."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.width = sample.shape[1]
        cells = max(1, min(round(math.sqrt(rows)), len(sample) // PER_CELL))
        self.centroids = fit(sample, cells)
        left = sample - self.centroids[closest(sample, self.centroids)]
        self.edges = np.linspace(0, self.width, min(PARTS, self.width) + 1).astype(int)
        self.books = [fit(left[:, a:b], ENTRIES) for a, b in zip(self.edges, self.edges[1:])]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of rows."""
        cell = closest(x, self.centroids)
        left = x - self.centroids[cell]
        return cell, np.stack([closest(left[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books)], axis=1).astype(np.uint8)

    def near(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the squared distance of a query to rows of a cell, by their codes."""
        left = q - self.centroids[cell]
        return sum(((left[a:b] - book) ** 2).sum(axis=1)[codes[:, p]] for p, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _placed(shape, unit: bool):
    """(vec_id, embedding): and cell and code of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("embedding"), shape.value.width)
                cell, codes = shape.value.place(_unit(x) if unit else x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "embedding", "cell", "code"])

    return run


def _probing(shape, unit: bool, probes: int):
    """(query_id, query_vector): a row for each of the nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = _matrix(batch.column("query_vector"), shape.value.width)
                d = distances(_unit(q) if unit else q, shape.value.centroids)
                cells = np.argsort(d, axis=1, kind="stable")[:, :probes]
                again = pa.array(np.repeat(np.arange(len(q)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(again), batch.column("query_vector").take(again), pa.array(cells.ravel(), pa.int32())], names=["query_id", "query_vector", "cell"])

    return run


def _slices(shape, unit: bool, most: int, kinds: list[pa.DataType]):
    """A slice's rows and the queries that probe it: the `most` rows that seem nearest to each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            ids = left.column("vec_id").combine_chunks()
            order = np.argsort(np.array(ids.to_pylist()), kind="stable")  # ties go to smaller ids
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(left), -1)[order]
            q = _matrix(right.column("query_vector").combine_chunks(), shape.value.width)
            for query, vector, cell in zip(right.column("query_id").to_pylist(), _unit(q) if unit else q, right.column("cell").to_pylist()):
                about = shape.value.near(vector, cell, codes)
                best = np.argsort(about, kind="stable")[:most]
                found += [(query, cell, ids[int(order[i])].as_py(), float(about[i])) for i in best]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 4, kinds)], names=["query_id", "cell", "vec_id", "about"])

    return run


class VectorIndex:
    """The index in a folder: build(), then search(), in this session or another one (by open()).

    metric is l2sq or cosine (inner products have no nearest cell). Vectors have one width, that of most rows of the sample; rows
    whose vector is null, of another width, or holds null or non-finite components are not indexed, as nothing is near to them.
    """

    def __init__(self, spark: SparkSession, folder: str, metric: str, shape: Shape | None):
        self.spark, self.folder, self.metric, self.shape = spark, folder, metric, shape
        self.held = spark.sparkContext.broadcast(shape)  # at most SAMPLE / PER_CELL centroids and PARTS * ENTRIES entries

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, metric: str = "l2sq", sample: int = SAMPLE) -> VectorIndex:
        """vectors (vec_id, embedding): a new index of all of them, fitted on at most `sample`."""
        if metric not in ("l2sq", "cosine"):
            raise ValueError(f"no index for {metric}")
        spark = vectors.sparkSession
        rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(_sound("embedding"), F.lit(False)))
        seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        widths = [len(r["embedding"]) for r in seen]
        width = max(set(widths), key=lambda w: (widths.count(w), -w), default=0)
        if not width:
            index = cls(spark, folder, metric, None)
            spark.createDataFrame([], rows.schema).withColumns({"slice": F.lit(0), "code": F.lit(b""), "cell": F.lit(0)}).write.mode("overwrite").parquet(f"{folder}/rows")
        else:
            x = np.array([r["embedding"] for r in seen if len(r["embedding"]) == width], np.float64)
            index = cls(spark, folder, metric, Shape(_unit(x) if metric == "cosine" else x, rows.count()))
            kind = rows.schema["vec_id"].dataType.simpleString()
            placed = settled(rows.where(F.size("embedding") == width).mapInArrow(_placed(index.held, metric == "cosine"), f"vec_id {kind}, embedding array<double>, cell int, code binary"))
            sizes = placed.groupBy("cell").agg((F.floor(F.count("*") / SLICE) + 1).cast("int").alias("slices"))
            cut = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int")).drop("slices")
            cut.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
        index._keep_shape()
        return index

    def _keep_shape(self) -> None:
        """The numbers that open() needs, as rows: bounded, as is what they were fitted on."""
        shape, rows = self.shape, [("metric", 0, 0, [], self.metric)]
        if shape is not None:
            rows += [("centroid", 0, i, c.tolist(), "") for i, c in enumerate(shape.centroids)] + [("edges", 0, 0, [float(e) for e in shape.edges], "")]
            rows += [("entry", p, i, e.tolist(), "") for p, book in enumerate(shape.books) for i, e in enumerate(book)]
        self.spark.createDataFrame(rows, "kind string, part int, at int, v array<double>, text string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/shape")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{folder}/shape").collect(), key=lambda r: (r["kind"], r["part"], r["at"]))
        of = lambda kind, part=0: np.array([r["v"] for r in rows if r["kind"] == kind and r["part"] == part], np.float64)
        shape = None
        if any(r["kind"] == "centroid" for r in rows):
            shape = Shape.__new__(Shape)
            shape.centroids, shape.edges = of("centroid"), of("edges")[0].astype(int)
            shape.width = shape.centroids.shape[1]
            shape.books = [of("entry", p) for p in range(len(shape.edges) - 1)]
        return cls(spark, folder, next(r["text"] for r in rows if r["kind"] == "metric"), shape)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def search(self, queries: DataFrame, k: int = 5, threshold: float | None = 0.2, probes: int = PROBES, refine: int = REFINE) -> DataFrame:
        """queries (query_id, query_vector): (query_id, vec_id, score, rank), as search.nearest() gives it, from the probed cells.

        With as many probes as cells and a refine that spans them the rows are those of the brute-force search. Queries without a
        sound vector of the index's width find nothing.
        """
        rows, unit = self.rows(), self.metric == "cosine"
        q = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        kinds = {"query_id": q.schema["query_id"].dataType, "vec_id": rows.schema["vec_id"].dataType}
        if self.shape is None:
            return self.spark.createDataFrame([], f"query_id {kinds['query_id'].simpleString()}, vec_id {kinds['vec_id'].simpleString()}, score double, rank int")
        q = q.where(F.coalesce(_sound("query_vector") & (F.size("query_vector") == self.shape.width), F.lit(False)))
        ask = q.mapInArrow(_probing(self.held, unit, probes), f"query_id {kinds['query_id'].simpleString()}, query_vector array<double>, cell int")
        ask = settled(ask.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(q.count() // QUERIES + 1))))
        cells = sorted(r["cell"] for r in ask.select("cell").distinct().collect())  # at most all cells, which are bounded
        probed = rows.where(F.col("cell").isin(cells))
        places = settled(probed.select("cell", "slice").distinct())
        met = ask.join(F.broadcast(places), "cell")
        parts = ask.select(F.col("cell").alias("of_cell"), F.col("part").alias("of_part")).distinct()
        codes = probed.select("vec_id", "cell", "slice", "code").join(parts, F.col("cell") == F.col("of_cell")).select("vec_id", F.col("of_cell"), F.col("slice").alias("of_slice"), "of_part", "code")
        run = _slices(self.held, unit, refine * k, [to_arrow_type(kinds["query_id"]), pa.int32(), to_arrow_type(kinds["vec_id"]), pa.float64()])
        ddl = f"query_id {kinds['query_id'].simpleString()}, cell int, vec_id {kinds['vec_id'].simpleString()}, about double"
        about = codes.groupBy("of_cell", "of_slice", "of_part").cogroup(met.groupBy("cell", "slice", "part")).applyInArrow(run, ddl)
        order = Window.partitionBy("query_id").orderBy("about", "vec_id")
        best = about.withColumn("place", F.row_number().over(order)).where(F.col("place") <= refine * k).select("query_id", F.col("cell").alias("in_cell"), F.col("vec_id").alias("of_vec"))
        exact = best.join(probed.select("cell", "vec_id", "embedding"), (F.col("cell") == F.col("in_cell")) & (F.col("vec_id") == F.col("of_vec"))).join(q, "query_id")
        scored = exact.select("query_id", "vec_id", F.round(score_of(self.metric, F.col("embedding"), F.col("query_vector")), PLACES).alias("score"))
        found = top(scored, k, of="vec_id")
        return found if threshold is None else found.where(F.col("score") >= threshold)


def _sound(name: str) -> Column:
    return (F.size(name) > 0) & ~F.exists(name, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Both (query_id, vec_id): one row (queries, wanted, found, recall), the share of the exact results that were found."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.when(F.col("wanted") > 0, F.round(F.col("found") / F.col("wanted"), PLACES)))
