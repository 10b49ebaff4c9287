"""Operator 4, near duplicates of embeddings: random-hyperplane signs in several tables, exact cosine, components.

1. Equal vectors form a class with a number of its own, which carries how many rows it stands for and their smallest vec_id.
2. TABLES times, the signs of BITS random projections give a code; equal codes of a table are a bucket. BITS follows the
   logarithm of the number of vectors, so buckets of unrelated vectors keep their size, and TABLES follows BITS so that a
   pair at a cosine of 0.9 shares a bucket with a probability of RECALL (nearer pairs: more).
3. Only the signs travel to the buckets, a few bytes a vector. Vectors at a cosine of 0.9 differ in about a seventh of all
   signs, unrelated ones in half: members without another one in reach by their signs are done with. A large bucket is dealt
   out as pairs of blocks of at most BLOCK members.
4. The vectors of those left follow them, and all cosines of a block are computed in double precision. No pair is emitted: a
   task returns, for each vector, how many it is linked to, and a link to the smallest member of its component in the block.
   A pair in several buckets counts in the first table that it shares, so every link counts once.
5. The links between members and smallest members give the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stash, table
from .components import components

RECALL = 0.995
#: Vectors of a bucket that unrelated ones may make up on average.
UNRELATED = 24
BLOCK = 256
#: Standard deviations by which the signs of a pair at the least cosine may differ more than they should.
SPREAD = 5.5
SEED = 20_24


def plan(n: int, least: float) -> tuple[int, int]:
    """(bits, tables) for n vectors and a least cosine."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / UNRELATED)))
    share = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - share))) if share < 1 else 1


def hyperplanes(width: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, count))


def reach(bits: int, tables: int, least: float) -> int:
    """Signs that two vectors may differ in to be compared."""
    p, n = math.acos(max(-1.0, min(1.0, least))) / math.pi, bits * tables
    return math.ceil(n * p + SPREAD * math.sqrt(n * p * (1 - p)))


SIGNED_DDL = "class long, weight long, width int, v binary, signs binary"


def _signs(bits: int, tables: int):
    """(class, weight, width, v, signs) of distinct vectors: v as bytes, in single precision where that is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            packed, out, widths = [], [], []
            for v in batch.column("v").to_pylist():
                x = np.array(v, np.float64)
                x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))  # by a power of two, so exactly: squares stay finite
                single = x.astype(np.float32)
                packed.append((single if (single == x).all() else x).tobytes())
                if len(x) not in planes:
                    planes[len(x)] = hyperplanes(len(x), bits * tables)
                signs = np.packbits(x @ planes[len(x)] > 0).tobytes()
                out.append(signs + bytes(-len(signs) % 8))
                widths.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("weight"), pa.array(widths, pa.int32()), pa.array(packed, pa.binary()), pa.array(out, pa.binary())], names=["class", "weight", "width", "v", "signs"])

    return run


def codes_of(signs: list[bytes], bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): each table's code, from the signs."""
    flat = np.unpackbits(np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1), axis=1, count=bits * tables)
    return flat.reshape(len(signs), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _keys(bits: int, tables: int):
    """(key, class, width, signs) for each table: the bucket's key is the table and the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = (np.arange(tables, dtype=np.int64) << 40) | codes_of(batch.column("signs").to_pylist(), bits, tables)
            again = pa.array(np.repeat(np.arange(len(batch)), tables))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(batch.column(c).take(again) for c in ("class", "width", "signs"))], names=["key", "class", "width", "signs"])

    return run


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each pair of rows of packed signs, in how many they differ."""
    out = np.zeros((len(one), len(other)), np.int32)
    for k in range(one.shape[1]):
        out += np.bitwise_count(one[:, k][:, None] ^ other[:, k][None, :])
    return out


def _first_shared(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table_no: int) -> np.ndarray:
    """Of pairs of a bucket, those that share no earlier table's code."""
    return ~(codes[i, :table_no] == codes[j, :table_no]).any(axis=1)


def _by_group(names: tuple[str, ...], close):
    """mapInArrow function that calls close(rows) for each run of rows with equal (key, bi, bj) and more than one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = {c: [] for c in names}, None
        for batch in batches:
            columns, start = {c: batch.column(c).to_pylist() for c in names}, 0
            group = list(zip(columns["key"], columns["bi"], columns["bj"]))
            for k in range(len(group) + 1):
                if k == len(group) or group[k] != at:
                    for c in names:
                        held[c] += columns[c][start:k]
                    start = k
                    if k < len(group):
                        if len(held["class"]) > 1:
                            yield close(held)
                        held, at = {c: [] for c in names}, group[k]
        if len(held["class"]) > 1:
            yield close(held)

    return run


def _sides(rows: dict) -> tuple[np.ndarray, np.ndarray, bool]:
    block = np.array(rows["block"], np.int64)
    return np.flatnonzero(block == rows["bi"][0]), np.flatnonzero(block == rows["bj"][0]), rows["bi"][0] == rows["bj"][0]


def _in_reach(bits: int, tables: int, most: int):
    """Of each block the members that have another one in reach by their signs, which no earlier table brings together."""
    names = ("key", "bi", "bj", "block", "class")

    def close(rows: dict) -> pa.RecordBatch:
        one, other, same = _sides(rows)
        words = np.frombuffer(b"".join(rows["signs"]), np.uint64).reshape(len(rows["class"]), -1)
        width = np.array(rows["width"])
        near = (_apart(words[one], words[other]) <= most) & (width[one][:, None] == width[other][None, :])
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        i, j = one[i], other[j]
        if len(i):
            first = _first_shared(codes_of(rows["signs"], bits, tables), i, j, rows["key"][0] >> 40)
            i, j = i[first], j[first]
        left = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array([rows[c][k] for k in left], pa.int32() if c in ("bi", "bj", "block") else pa.int64()) for c in names], names=list(names))

    return _by_group((*names, "width", "signs"), close)


def cosines(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In double precision, of all pairs of rows."""
    length = lambda x: np.sqrt((x * x).sum(axis=1))
    return (one @ other.T) / (length(one)[:, None] * length(other)[None, :])


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the least one reachable over the links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


FOUND = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def _block_links(bits: int, tables: int, least: float):
    """Of each block (class, how many rows it is linked to by pairs that count here, the least class joined to it)."""

    def close(rows: dict) -> pa.RecordBatch:
        one, other, same = _sides(rows)
        ids, weight, width = (np.array(rows[c], np.int64) for c in ("class", "weight", "width"))
        i, j = [], []
        for w in np.unique(width):  # vectors of other widths have no cosine
            a, b = one[width[one] == w], other[width[other] == w]
            x = {k: np.frombuffer(rows["v"][k], f"<f{len(rows['v'][k]) // w}").astype(np.float64) for k in (*a, *b)}
            if len(a) and len(b):
                near = cosines(np.array([x[k] for k in a]), np.array([x[k] for k in b])) >= least
                at = np.nonzero(np.triu(near, 1) if same else near)
                i.append(a[at[0]]), j.append(b[at[1]])
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (i, j))
        if len(i):
            first = _first_shared(codes_of(rows["signs"], bits, tables), i, j, rows["key"][0] >> 40)
            i, j = i[first], j[first]
        n = len(ids)
        links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
        root = _smallest(n, i, j)
        out = [(int(ids[k]), int(links[k]), int(ids[root[k]])) for k in np.flatnonzero(links)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 3, FOUND)], schema=FOUND)

    return _by_group(("class", "weight", "width", "v", "signs", "block", "key", "bi", "bj"), close)


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vectors (vec_id, embedding, ...): (vec_id, n_links, component_id, kept), a row for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows without vec_id
    (component_id null, kept). Vectors of different widths do not link. Rows that repeat a vec_id count each as a vector, with
    links and a component of its own. Other columns, whatever their names, are not read; an empty table gives an empty one.
    """
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, e).alias("v"))
    # numbered as it is written: whoever reads the table sees the same numbers
    classes = stash(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("class", F.monotonically_increasing_id()))
    bits, tables = plan(classes.count(), least)

    signed = stash(classes.select("class", "weight", "v").mapInArrow(_signs(bits, tables), SIGNED_DDL))
    keys = signed.select("class", "width", "signs").mapInArrow(_keys(bits, tables), "key long, class long, width int, signs binary")
    sizes = signed.select("class", "width", "signs").mapInArrow(_keys(bits, tables), "key long, class long, width int, signs binary").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(sizes, "key")
    members = members.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    group = ("key", "bi", "bj")
    dealt = members.select(*group, "block", "class", "width", "signs").repartition(*group).sortWithinPartitions(*group)
    left = stash(dealt.mapInArrow(_in_reach(bits, tables, reach(bits, tables, least)), "key long, bi int, bj int, block int, class long"))
    dealt = left.join(signed, "class").select(*group, "block", "class", "weight", "width", "v", "signs").repartition(*group).sortWithinPartitions(*group)
    found = stash(dealt.mapInArrow(_block_links(bits, tables, least), "class long, n long, root long"))

    labels = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("class").agg(F.sum("n").alias("n"))
    for spent in (signed, left):
        drop(spent)
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("least").alias("of_class"))
    of_class = named.join(smallest, "component").join(links, "class", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "of_class")
    out = rows.join(of_class, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("of_class", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
