"""Plumbing shared by the corpus operators: scratch tables, input reading, word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: whichever is reached first ends it, so long documents make short batches.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20
#: Distinct words a worker remembers before it starts again.
WORD_CACHE = 200_000
#: Bytes of the longest words that are remembered.
LONG = 128

#: Sizes from here on are Catalyst's way to say that it does not know.
UNKNOWN = 1 << 60

_scratch: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches bound the Python workers' memory.

    Also sends this package to the executors, which need not have it installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="tessella-code-")  # the driver serves it as long as the session lasts
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(out.filename)
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers open."""
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; a folder of this machine only where all of Spark runs in it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessella"


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of stash() that nothing will read again."""
    path = getattr(df, "_tessella_path", None)
    if path:
        _delete(df.sparkSession, path)
        _scratch[:] = [x for x in _scratch if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder goes with the cluster's own cleaning
            return


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size, which for files is their size; where it knows none, the rows are measured."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < UNKNOWN:
        return known
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return df.select(sum(wide, F.lit(8 * len(df.columns))).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0


def buckets_for(df: DataFrame, bytes_each: int, factor: float = 1.0) -> int:
    """How many hash buckets keep each below bytes_each; never fewer than the shuffle partitions."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(input_bytes(df) * factor / bytes_each) + 1)


def by_bucket(df: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Each bucket in a partition of its own, its rows together."""
    return df.repartitionById(n, F.col(column)).sortWithinPartitions(column)


def as_bytes(column) -> list:
    """UTF-8 bytes (or None) of an Arrow string column, without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered; call trim() between documents to bound its memory."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= LONG:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > WORD_CACHE:
            self.clear()

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(h: np.ndarray, n: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of n consecutive words, from the words' hashes; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    k, out = np.uint64(multiplier), h[:m].copy()
    for i in range(1, n):
        out *= k
        out += h[i : i + m]
    return mix64(out)
