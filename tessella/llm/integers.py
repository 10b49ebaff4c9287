"""Vectors as exact integers, packed: what the operators of whitening and of codes start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Integers up to here are held in 64 bits with room to spare.
LIMIT = 1 << 62
#: Rows that are computed on as one matrix at least, where a task has so many.
ROWS = 16_384


def _packed(scale: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            x = np.floor(c * scale).astype("<i8") + offset  # a power of two: the product is exact
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), *(batch.column(i) for i in range(2, batch.num_columns))], names=["vec_id", "x", *batch.schema.names[2:]])

    return run


def integer_vectors(vectors: DataFrame, scale: int, offset: int = 0, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """vectors (vec_id, embedding, ...): ((vec_id, x, *carry), width), x being floor(scale * component) + offset in 64 bits each.

    The rows are written out, a row for each sound one. Rows go whose vector is null, empty or holds null or non-finite
    components, or components that fill no 64-bit integer when scaled. Where vectors have several widths, those of the most
    frequent one stay (of equally frequent ones, of the smallest). carry names columns to hand through, as null where there is
    none. Other columns, whatever their names, are not read. scale is a power of two. Width 0: there is no sound row.
    """
    spark, e = vectors.sparkSession, F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(LIMIT // scale))
    handed = [F.col(f"`{c}`") if c in vectors.columns else F.lit(None).cast("int").alias(c) for c in carry]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"), *handed)
    sound = rows.where(F.coalesce((F.size("v") > 0) & ~F.exists("v", bad), F.lit(False)))
    widths = sound.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    most = widths.orderBy(F.desc("n"), "width").first()
    kinds = ", ".join(["vec_id long", "x binary", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)])
    if most is None:
        return spark.createDataFrame([], kinds), 0
    return stash(sound.where(F.size("v") == most["width"]).mapInArrow(_packed(scale, offset), kinds)), most["width"]


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """(rows, width) of packed vectors."""
    return np.frombuffer(b"".join(packed), "<i8").reshape(-1, width)


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive batches together, ROWS rows or a little more each: fewer, larger products."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as it is while its results stay below `most` times its largest entry in 64 bits; else as Python's integers."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return x if largest * most < LIMIT else x.astype(object)
