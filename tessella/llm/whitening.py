"""Operator 11, whitening of embeddings with an exact covariance: digit-slice products of matrices.

1. Components become integers x, and their sums S over all n vectors are taken exactly: partial sums of each task, merged by
   Spark. So y = n * x - S is a vector of integers, too, n times the centred vector, without any rounding.
2. The covariance is the sum of y'y over n cubed. Each task cuts its integers into limbs of LIMB bits and multiplies limb
   matrices in double precision: a product of two limbs has 2 * LIMB bits, and a block has so few rows that the sums stay
   below 2^53, so BLAS computes them exactly. The limbs' products are put together as big integers.
3. A task returns its big integers in pieces of PIECE bits, a row for each entry of the upper triangle; Spark sums the pieces.
   What reaches the driver is a row an entry, whatever the number of vectors. The quotient by n cubed is rounded once.
4. The eigenvectors of that matrix are broadcast (COMPONENTS times the width), and every vector is projected.

The covariance of the whitened rows is measured over all of them, by Spark's own centred covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stash, table
from .integers import LIMIT, exact, in_blocks, integer_vectors, matrix

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LIMB = 20
#: Rows of a block: 2^12 products of 2 * 20 bits add up to less than 2^53.
BLOCK = 1 << 12
#: Bits of a piece of a big integer: sums of 2^22 tasks' pieces fit 64 bits.
PIECE = 40
#: Eigenvalues below this part of the largest one can't be told from rounding errors to 0.0001.
NOISE = 1e-11

NUMBER = pa.decimal128(38, 0)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as the sum of limbs times powers of 2^LIMB, each in doubles; the last one carries the sign."""
    out, most = [], 1 << (LIMB - 1)
    while y.size and (int(y.max()) >= most or int(y.min()) < -most):
        low = y & ((1 << LIMB) - 1)
        out.append(low.astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


class Products:
    """The sum of y'y over blocks of rows, exactly: 64-bit sums for each pair of limbs, big integers at the end."""

    def __init__(self, width: int):
        self.width, self.sums, self.blocks = width, {}, 0
        self.total = np.zeros((width, width), object)

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), BLOCK):
            parts = limbs(y[at : at + BLOCK])
            for i, one in enumerate(parts):
                for j, other in enumerate(parts):
                    product = (one.T @ other).astype(np.int64)
                    self.sums[i + j] = self.sums.get(i + j, 0) + product
            self.blocks += 1
            if self.blocks == 64:  # at most 16 pairs of limbs share a power: 2^52 * 64 * 16 is 2^62
                self.carry()

    def carry(self) -> None:
        for power, part in self.sums.items():
            self.total = self.total + part.astype(object) * (1 << (LIMB * power))
        self.sums, self.blocks = {}, 0

    def result(self) -> np.ndarray:
        self.carry()
        return self.total


def pieces(value: int, count: int) -> list[int]:
    """value as count pieces of PIECE bits, the lowest first; the last one carries the sign."""
    out = []
    for _ in range(count - 1):
        out.append(value & ((1 << PIECE) - 1))
        value >>= PIECE
    return [*out, value]


def _sums(width: int):
    """(place, total) of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for block in in_blocks(batches):
            x = matrix(block.column("x").to_pylist(), width)
            total = total + exact(x, len(x)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(int(v)) for v in total], NUMBER)], names=["place", "total"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly."""
    x = exact(x, 2 * n)
    y = x * n - (sums if x.dtype == object else sums.astype(np.int64))
    return exact(y, 1)


def _gram(width: int, n: int, sums: np.ndarray, count: int):
    """(cell, p0, p1, ...): a task's sum of y'y, in pieces, for each entry of the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, some = Products(width), False
        for block in in_blocks(batches):
            products.add(_centred(matrix(block.column("x").to_pylist(), width), n, sums))
            some = True
        if some:
            total = products.result()
            cells = [(i * width + j, *pieces(int(total[i, j]), count)) for i in range(width) for j in range(i, width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cells)], names=["cell", *(f"p{k}" for k in range(count))])

    return run


def deviations(y: np.ndarray) -> list[int]:
    """The sum of squares of each row, exactly."""
    y = exact(y, 1)
    largest = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    if largest * largest * y.shape[1] < LIMIT:
        return [int(v) for v in (y * y).sum(axis=1)]
    parts, out = limbs(y), np.zeros(len(y), object)
    for i, one in enumerate(parts):
        for j, other in enumerate(parts):
            out = out + (one * other).sum(axis=1).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return [int(v) for v in out]


WHITE_DDL = "vec_id long, deviation decimal(38,0), w array<double>"


def _white(width: int, n: int, sums: np.ndarray, directions):
    """(vec_id, deviation, w): the whitened components of each vector. directions: (width, components), over sqrt(e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            y = _centred(matrix(block.column("x").to_pylist(), width), n, sums)
            w = (y.astype(np.float64) / n) @ directions.value
            apart = [Decimal(v) if v < 10**38 else None for v in deviations(y)]
            for at in range(0, len(y), 2000):
                part = slice(at, at + 2000)
                yield pa.RecordBatch.from_arrays([block.column("vec_id").combine_chunks().slice(at, 2000), pa.array(apart[part], NUMBER), pa.array(w[part].tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    return run


def covariance(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """rows (x): (n, exact sums, exact sum of y'y as big integers)."""
    merged = rows.mapInArrow(_sums(width), "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    n, sums = rows.count(), np.zeros(width, object)
    for r in merged.collect():  # a row a dimension
        sums[r["place"]] = int(r["total"])
    # |y| is at most n * (largest x) * 2; the largest x has 62 bits
    count = (2 * (n.bit_length() + 63) + n.bit_length()) // PIECE + 1
    names = [f"p{k}" for k in range(count)]
    cells = rows.mapInArrow(_gram(width, n, sums, count), ", ".join(["cell long", *(f"{p} long" for p in names)]))
    total = np.zeros((width, width), object)
    for r in cells.groupBy("cell").agg(*(F.sum(p).alias(p) for p in names)).collect():  # a row an entry of the triangle
        i, j = divmod(r["cell"], width)
        total[i, j] = total[j, i] = sum(r[p] << (PIECE * k) for k, p in enumerate(names))
    return n, sums, total


def principal(total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, the largest first; total is n cubed times it."""
    v = np.array([[int(c) / n**3 for c in row] for row in total], np.float64).reshape(total.shape)  # each rounded once
    e, u = np.linalg.eigh(v)
    return e[::-1], u[:, ::-1], int(sum(total.diagonal())) / n**3


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding, ...): (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact).

    A row for each sound vector (integers.integer_vectors() says which are) and each of the first components, or of all
    dimensions where there are fewer. Rows that repeat a vec_id, or have none, count each as a vector. A component without
    variance (equal vectors, fewer vectors than components) can't be whitened: its whitened is null, and identity_error is over
    the others, null where there are none; explained is 0 then. deviation is null beyond 64 bits; deviation_exact has 38
    decimal digits, and is null beyond. An empty table gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows, width = integer_vectors(vectors, SCALE, OFFSET)
    if not width:
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        return spark.createDataFrame([], kinds)
    n, sums, total = covariance(rows, width)
    e, u, trace = principal(total, n)
    shown = min(components, width)
    usable = [k for k in range(shown) if e[k] > max(e[0], 0.0) * NOISE]
    over = np.array([1 / np.sqrt(e[k]) if k in usable else 0.0 for k in range(shown)])
    directions = spark.sparkContext.broadcast(u[:, :shown] * over)
    white = stash(rows.mapInArrow(_white(width, n, sums, directions), WHITE_DDL))
    drop(rows)

    pairs = [(i, j) for i in usable for j in usable if i <= j]
    at = lambda k: F.col("w")[k]
    measured = white.agg(F.count("*").alias("n"), *(F.covar_pop(at(i), at(j)).alias(f"c_{i}_{j}") for i, j in pairs)).first()
    error = max((abs(measured[f"c_{i}_{j}"] - (i == j)) for i, j in pairs), default=None)
    share = F.array(*(F.lit(float(max(e[k], 0.0) / trace) if k in usable else 0.0) for k in range(shown)))
    sound = F.array(*(F.lit(k in usable) for k in range(shown)))
    each = white.select("vec_id", "deviation", F.posexplode("w").alias("k", "value"))
    return each.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.when(F.col("deviation") < F.lit(Decimal(1 << 63)), F.col("deviation")).cast("long").alias("deviation"),
        F.when(sound[F.col("k")], F.col("value")).alias("whitened"),
        share[F.col("k")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        F.col("deviation").alias("deviation_exact"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
