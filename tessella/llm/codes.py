"""Operator 12, compression of vectors to codes: a codebook a part of the vector, searched by kd-trees, moved to the means.

1. Components become integers; a vector is PARTS consecutive parts. Each part's codebook starts as that part of the ENTRIES
   rows with the smallest vec_ids.
2. A round builds a kd-tree for each codebook and broadcasts them: PARTS times ENTRIES entries, whatever the number of rows.
   Each task finds the nearest entry of every part by branch and bound. A node is passed over only if its box is farther than
   the best entry found so far; boxes at the very same distance are visited, so that of equally near entries the one with the
   lower index is found, wherever it stands in the tree.
3. A task returns sums and counts of the parts of each entry; Spark adds them up exactly, a row for a place of an entry. The
   driver divides, rounding down.

All distances and sums are integers: results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stash, table
from .integers import exact, in_blocks, integer_vectors, matrix

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Entries of a leaf of the tree at most, unless they are equal.
LEAF = 2
NUMBER = pa.decimal128(38, 0)


@dataclass
class Node:
    """low, high: the box around the entries below; members: their indices in a leaf, ascending."""

    low: np.ndarray
    high: np.ndarray
    members: list[int] | None = None
    left: Node | None = None
    right: Node | None = None


def build(entries: np.ndarray, members: list[int] | None = None) -> Node:
    """The kd-tree of a codebook: halves along the widest side, down to LEAF entries."""
    members = list(range(len(entries))) if members is None else members
    held = entries[members]
    node = Node(held.min(axis=0), held.max(axis=0))
    spread = node.high - node.low
    axis = int(np.argmax(spread))
    if len(members) <= LEAF or not spread[axis]:
        node.members = sorted(members)
        return node
    order = sorted(members, key=lambda k: (entries[k][axis], k))
    node.left, node.right = build(entries, order[: len(order) // 2]), build(entries, order[len(order) // 2 :])
    return node


def nearest(tree: Node, entries: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row of q; of equally near ones the lowest index."""
    at = np.full(len(q), len(entries), np.int64)
    best = np.full(len(q), np.iinfo(np.int64).max, q.dtype)
    if q.dtype == object:
        best[:] = 1 << 200

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        x = q[rows]
        off = np.maximum(np.maximum(node.low - x, x - node.high), 0)
        return (off * off).sum(axis=1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.members is not None:
            for k in node.members:
                off = q[rows] - entries[k]
                d = (off * off).sum(axis=1)
                nearer = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
                best[rows[nearer]], at[rows[nearer]] = d[nearer], k
            return
        left, right = bound(node.left, rows), bound(node.right, rows)
        first = left <= right
        for side, near, far, beyond in ((first, node.left, node.right, right), (~first, node.right, node.left, left)):
            mine, least = rows[side], beyond[side]
            visit(near, mine)
            visit(far, mine[least <= best[mine]])  # equal bounds, too: a lower index may lie there

    visit(tree, np.arange(len(q)))
    return at, best


class Books:
    """The codebooks and their trees, as they are broadcast."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (parts, entries, places)
        self.trees = [build(e) for e in entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x (rows, parts, places): index and squared distance (rows, parts)."""
        largest = int(np.abs(self.entries).max(initial=0)) + max(abs(int(x.max())), abs(int(x.min())))
        kind = np.int64 if largest * largest * x.shape[2] < 1 << 62 else object
        found = [nearest(t, e.astype(kind), x[:, p].astype(kind)) for p, (t, e) in enumerate(zip(self.trees, self.entries))]
        return np.stack([a for a, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _parts(block: pa.Table, width: int, places: int) -> np.ndarray:
    """(rows, parts, places): widths that are no multiple of the number of parts are filled up with zeros."""
    x = matrix(block.column("x").to_pylist(), width)
    return np.pad(x, ((0, 0), (0, PARTS * places - width))).reshape(len(x), PARTS, places)


SUMS_DDL = "part int, entry int, place int, n long, total decimal(38,0)"


def _sums(books, width: int, places: int):
    """(part, entry, place, n, total) of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.value.entries.shape[1]
        n, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, places), object)
        for block in in_blocks(batches):
            x = _parts(block, width, places)
            at, _ = books.value.assign(x)
            x = exact(x, len(x))
            for p in range(PARTS):
                order = np.argsort(at[:, p], kind="stable")
                there, starts = np.unique(at[order, p], return_index=True)
                total[p, there] += np.add.reduceat(x[order, p], starts, axis=0).astype(object)
                n[p] += np.bincount(at[:, p], minlength=entries)
        rows = [(p, k, i, int(n[p, k]), Decimal(int(total[p, k, i]))) for p, k in np.argwhere(n).tolist() for i in range(places)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), NUMBER)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["part", "entry", "place", "n", "total"])

    return run


def _coded(books, width: int, places: int):
    """(vec_id, label, code, error) of each row; an error beyond 64 bits is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            at, apart = books.value.assign(_parts(block, width, places))
            errors = [int(v) for v in exact(apart, PARTS).sum(axis=1)]
            codes = [r.tobytes().hex() for r in at.astype(np.uint8)]
            out = pa.table({"vec_id": block.column("vec_id"), "label": block.column("label"), "code": pa.array(codes, pa.string()), "error": pa.array([v if v < 1 << 63 else None for v in errors], pa.int64())})
            yield from out.combine_chunks().to_batches(max_chunksize=2000)

    return run


def codebooks(rows: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """rows (vec_id, x): the entries (parts, entries, places) after so many rounds."""
    spark, places = rows.sparkSession, -(-width // PARTS)
    first = [r["x"] for r in rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()]
    x = np.pad(matrix(first, width), ((0, 0), (0, PARTS * places - width)))
    entries = x.reshape(len(first), PARTS, places).transpose(1, 0, 2).astype(np.int64)
    for _ in range(rounds):
        books = spark.sparkContext.broadcast(Books(entries))
        merged = rows.mapInArrow(_sums(books, width, places), SUMS_DDL).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        new = entries.copy()
        for r in merged.collect():  # at most a row for each place of each entry
            new[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books.unpersist()
        if (new == entries).all():  # so would all further rounds leave them
            break
        entries = new
    return entries


def compressed(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label, ...): (vec_id, code, error, label_error, codebooks_sha256), a row for each sound vector.

    integers.integer_vectors() says which vectors are sound. A width that is no multiple of PARTS is filled up with zeros. With
    fewer than ENTRIES rows the codebooks have an entry a row. Rows that repeat a vec_id count each as a vector, in order of
    their components where they are among the first; rows without one come last. Without a column label all labels are null;
    rows whose label is null count as one label. Errors beyond 64 bits are null. An empty table gives an empty one. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows, width = integer_vectors(vectors, SCALE, carry=("label",))
    if not width:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    entries = codebooks(rows, width)
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    books = spark.sparkContext.broadcast(Books(entries))
    label = rows.schema["label"].dataType.simpleString()
    coded = stash(rows.mapInArrow(_coded(books, width, -(-width // PARTS)), f"vec_id long, label {label}, code string, error long"))
    drop(rows)
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))
