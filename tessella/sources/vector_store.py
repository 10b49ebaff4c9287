"""A vector store in a folder, and the cache of embeddings that it is filled from.

A store's rows lie in BUCKETS by their ids. Every change writes a new version of the buckets that it touches, and then the list of
versions: readers see a change as a whole or not at all, and a change that failed is not seen and does no harm. Old versions of
a bucket stay until vacuum().
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.embedding import Embedder
from .scratch import settled

BUCKETS = 16


class EmbeddingCache:
    """text -> vector for one model, in a folder: each distinct text is embedded once, in this session or an earlier one.

    Texts are told apart by their SHA-256. Additions are appended as they are complete; if two fill the same gap at once, both
    vectors are there and one counts. A null text has no vector and is not kept.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str, embed: Embedder):
        self.spark, self.folder, self.model, self.embed = spark, folder.rstrip("/"), model, embed
        self.embedded = 0  # texts that this object has embedded

    def rows(self) -> DataFrame:
        """(digest, vector) of the model."""
        try:
            kept = self.spark.read.parquet(self.folder)
        except AnalysisException:  # nothing was kept yet
            return self.spark.createDataFrame([], "digest string, vector array<double>")
        return kept.where(F.col("model") == self.model).groupBy("digest").agg(F.min("vector").alias("vector"))

    def vectors(self, texts: DataFrame, column: str = "text", name: str = "vector") -> DataFrame:
        """texts with the vector of a column's text; hits are joined, misses embedded once a distinct text and kept."""
        digest = F.sha2(F.col(column).cast("string"), 256)
        keyed = texts.withColumn("__digest", digest)
        asked = keyed.where(F.col(column).isNotNull()).groupBy("__digest").agg(F.min(F.col(column).cast("string")).alias("__text"))
        missed = settled(asked.join(self.rows().select(F.col("digest").alias("__digest")), "__digest", "left_anti"))
        count = missed.count()
        if count:
            made = missed.select(F.col("__digest").alias("digest"), self.embed(F.col("__text")).alias("vector"), F.lit(self.model).alias("model"))
            made.write.mode("append").partitionBy("model").parquet(self.folder)
            self.embedded += count
        return keyed.join(self.rows().select(F.col("digest").alias("__digest"), F.col("vector").alias(name)), "__digest", "left").drop("__digest")


class VectorStore:
    """Rows (id, ...) by their ids. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def versions(self) -> dict[int, int]:
        """bucket -> its version that counts."""
        try:
            return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.folder}/versions").groupBy("bucket").agg(F.max("version").alias("version")).collect()}
        except AnalysisException:
            return {}

    def _bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_.cast("string")), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame | None:
        """All rows; None before the first addition."""
        counted = self.versions()
        if not counted:
            return None
        columns = self.spark.read.parquet(f"{self.folder}/columns").schema  # there may be no row left that tells them
        kept = self.spark.read.schema(columns.add("version", IntegerType()).add("bucket", IntegerType())).option("basePath", f"{self.folder}/rows").parquet(*(f"{self.folder}/rows/version={v}" for v in sorted(set(counted.values()))))
        which = F.lit(False)
        for bucket, version in counted.items():
            which = which | ((F.col("bucket") == bucket) & (F.col("version") == version))
        return kept.where(which).drop("version", "bucket")

    def _replace(self, touched: list[int], rows: DataFrame) -> None:
        """A new version of some buckets with these rows."""
        version = max(self.versions().values(), default=0) + 1
        path = f"{self.folder}/rows/version={version}"
        self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{self.folder}/columns")
        rows.withColumn("bucket", self._bucket(F.col("id"))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        self.spark.createDataFrame([(b, version) for b in touched], "bucket int, version int").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def _touched(self, ids: DataFrame) -> list[int]:
        return sorted(r["b"] for r in ids.select(self._bucket(F.col("id")).alias("b")).distinct().collect())  # at most all buckets

    def upsert(self, rows: DataFrame) -> None:
        """Add rows; those whose id is there already are replaced. Ids are unique within rows, and not null."""
        rows = settled(rows.where("id IS NOT NULL"))
        touched, kept = self._touched(rows), self.rows()
        if not touched:
            return
        if kept is not None:
            others = kept.where(self._bucket(F.col("id")).isin(touched)).join(rows.select("id"), "id", "left_anti")
            rows = rows.unionByName(others, allowMissingColumns=True)
        self._replace(touched, rows)

    def delete(self, ids: DataFrame) -> None:
        """Drop the rows of these ids; only buckets that hold one of them are written anew."""
        kept, ids = self.rows(), ids.select("id").where("id IS NOT NULL").distinct()
        if kept is None:
            return
        touched = self._touched(kept.select("id").join(ids, "id", "left_semi"))
        if touched:
            self._replace(touched, kept.where(self._bucket(F.col("id")).isin(touched)).join(ids, "id", "left_anti"))

    def vacuum(self) -> None:
        """Delete versions that no bucket counts any more."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        counted = {f"version={v}" for v in self.versions().values()}
        for f in files.listStatus(root) if files.exists(root) else ():
            if f.getPath().getName() not in counted:
                files.delete(f.getPath(), True)
