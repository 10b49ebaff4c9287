"""The list of queries: a callable on (spark, sf_dir), and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.keyword_index import KeywordIndex
from ..operators.vector_index import VectorIndex
from ..sources.scratch import working_folder

Query = Callable[[SparkSession, str], DataFrame]

#: The tables that derived cases may name.
NAMES = ("conversations", "documents", "events", "orders", "pages")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: The indexes of each session and version of a table's files: built by the first search, used by all that follow.
_indexes: dict[tuple, KeywordIndex | VectorIndex] = {}


class Cases:
    """Worked cases, and rows like them that a SELECT makes of the tables; it is written so that both engines read it."""

    def __init__(self, values: str, columns: str, derived: str):
        self.values, self.columns, self.derived = values, columns, derived

    def __str__(self) -> str:
        """What stands behind FROM."""
        return f"(SELECT * FROM (VALUES {self.values}) v({self.columns}) UNION ALL {self.derived}) t({self.columns})"


class Tables:
    """The tables of a folder by name, read with nothing but the columns that a plan uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream_path(self, name: str) -> str:
        """A table's path for streams: as a pattern, which may name a folder or a single file."""
        return f"{self.folder}/{name}.parque[t]"

    def _version(self, name: str) -> tuple:
        """The session and the files of a table: another version of the files is another key."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return (self.spark.sparkContext.applicationId, *sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files))

    def keyword_index(self) -> KeywordIndex:
        """The index of the documents."""
        key = ("keyword", *self._version("documents"))
        if key not in _indexes:
            _indexes[key] = KeywordIndex.build(self.documents.select("doc_id", "text"), working_folder(self.spark))
        return _indexes[key]

    def vector_index(self, metric: str = "l2sq") -> VectorIndex:
        """The index of the embeddings."""
        key = ("vector", metric, *self._version("embeddings"))
        if key not in _indexes:
            _indexes[key] = VectorIndex.build(self.embeddings.select("vec_id", "embedding"), working_folder(self.spark), metric)
        return _indexes[key]

    def cases(self, given: Cases) -> DataFrame:
        names = {n: getattr(self, n) for n in given.derived.split() if n in NAMES}
        made = re.sub(rf"\b({'|'.join(NAMES)})\b", r"{\1}", given.derived)
        return self.rows(given.values, given.columns).union(self.spark.sql(f"SELECT * FROM ({made}) AS t({given.columns})", **names))

    def rows(self, values: str, columns: str) -> DataFrame:
        """A table written out as SQL values."""
        return self.spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of Tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
