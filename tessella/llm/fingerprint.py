"""Operator 2, document fingerprints: a canonical exact digest.

The canonical form of a text is its Unicode normal form NFKC, case-folded, with each run of white space folded to one
blank and none at its ends. Its 128-bit xxhash is the digest. Texts of one digest are grouped and their canonical bytes
compared, so that a collision of the hash cannot give two different texts one fingerprint: where a digest has several
canonical texts, their fingerprints get the text's number (in byte order) behind the digest. Edited texts are compared with the
documents and with each other in the same way; only those travel for that whose digest another text has, too.

Likeness of two fingerprints is 1.0 if they are equal, else 0.0: the digest is exact, and says nothing of near texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, stash, table

#: Bytes of (packed) text that a block of neighbouring documents should have at most; a task reads it row by row.
BLOCK_BYTES = 256 << 20


def canonical(text: str | None) -> bytes:
    """The bytes that stand for a text; empty for null and for white space alone."""
    if not text:
        return b""
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes, digits: int = 32) -> str:
    """digits: hexadecimal digits of the hash that are kept, all 32 of them but in tests of collisions."""
    return xxhash.xxh3_128_hexdigest(canon)[:digits]


def raw_hash(text: str) -> int:
    """Tells rows of one doc_id apart."""
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def _bytes_of(edited: bool, digits: int):
    """Rows of whole texts, edited with the next one's if asked for: (digest, id, raw, next_id, next_raw, z), z the packed canonical bytes."""
    ids = ("id", "raw", "next_id", "next_raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if edited:
                texts = [edit(t, f or "") for t, f in zip(texts, batch.column("following").to_pylist())]
            canon = [canonical(t) for t in texts]
            own = [batch.column(c) if c in batch.schema.names else pa.nulls(len(batch), pa.int64()) for c in ids]
            yield pa.RecordBatch.from_arrays([pa.array([digest(c, digits) for c in canon], pa.string()), *own, pa.array([pack.compress(c) for c in canon], pa.binary())], names=["digest", *ids, "z"])

    return run


BYTES_DDL = "digest string, id long, raw long, next_id long, next_raw long, z binary"


def _packed(digits: int):
    """(digest, z) of whole texts: their packed canonical bytes, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            seen = dict.fromkeys(map(canonical, batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([digest(c, digits) for c in seen], pa.string()), pa.array([pack.compress(c) for c in seen], pa.binary())], names=["digest", "z"])

    return run


def collisions(found: DataFrame, given: DataFrame, digits: int = 32) -> DataFrame:
    """found (fingerprint, edited_fingerprint: digests; id, raw, next_id, next_raw) of the rows of given (doc_id, text).

    (digest, id, raw, next_id, next_raw, number): for digests that several canonical texts share, byte by byte, the number of
    each row's text (next_id and next_raw null) and edited text; as a rule the table is empty.
    """
    keys, texts = ["id", "raw", "next_id", "next_raw"], with_raw(given)
    every = found.select(F.col("fingerprint").alias("digest"), F.lit(0).alias("edited")).unionAll(found.select("edited_fingerprint", F.lit(1)))
    repeated = stash(every.groupBy("digest").agg(F.count("*").alias("n"), F.max("edited").alias("edited")).where("n > 1 and edited = 1").select("digest"))
    edited = stash(found.select(*keys, F.col("edited_fingerprint").alias("digest")).join(repeated, "digest", "left_semi").select(*keys).distinct())
    needed = stash(edited.select("id", "raw").unionAll(edited.select("next_id", "next_raw")).distinct())  # of edited texts only these travel
    whole = stash(texts.join(needed, ["id", "raw"], "left_semi").dropDuplicates(["id", "raw"]))
    following = whole.select(F.col("id").alias("next_id"), F.col("raw").alias("next_raw"), F.col("text").alias("following"))
    edited = stash(edited.join(whole, ["id", "raw"]).join(following, ["next_id", "next_raw"]).mapInArrow(_bytes_of(True, digits), BYTES_DDL))
    packed = given.select("text").mapInArrow(_packed(digits), "digest string, z binary").unionAll(edited.select("digest", "z"))
    several = stash(packed.groupBy("digest").agg(F.min("z").alias("least"), F.max("z").alias("most")).where("least <> most").select("digest"))
    if several.isEmpty():  # of 128 bits there are none, or a handful
        return several.select("digest", *(F.lit(None).cast("long").alias(k) for k in keys), F.lit(0).alias("number"))
    own = texts.mapInArrow(_bytes_of(False, digits), BYTES_DDL)
    clashing = stash(own.unionAll(edited).join(several, "digest", "left_semi").distinct())
    numbers = clashing.select("digest", "z").distinct().withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("z")) - 1)
    return stash(clashing.join(numbers, ["digest", "z"]).drop("z"))


def _resolve(rows: DataFrame, clashes: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """column: the digest, with the number of the row's canonical text behind it where the digest has several."""
    own = clashes.where("next_raw is not null" if "next_raw" in keys else "next_raw is null")
    hit = rows.join(own.select(*keys, "number"), keys, "left")
    return hit.withColumn(column, F.concat_ws("-", column, F.col("number").cast("string"))).drop("number")


def _cuts(docs: DataFrame, blocks: int) -> list[int]:
    """Ascending doc_ids that end the blocks, the last of them the largest; their number follows the input's size."""
    quantiles = [(i + 1) / blocks for i in range(blocks)]
    row = docs.agg(F.percentile_approx("doc_id", quantiles, 20 * blocks).alias("q"), F.max("doc_id").alias("top")).first()
    return sorted({*(row["q"] or []), *([row["top"]] if row["top"] is not None else [])})


def _deal(cuts: list[int], blocks: int):
    """(block, tail, doc_id, z): each row in its block; the largest of a block once more as the tail of the next one."""
    ends = np.array(cuts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, is_end = zstandard.ZstdCompressor(level=3), set(cuts)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                z = pack.compress((text or "").encode("utf-8", "surrogatepass"))
                block = 0 if doc_id is None else int(np.searchsorted(ends, doc_id))
                out.append((block, False, doc_id, z))
                if not cuts or doc_id in is_end:
                    out.append(((block + 1) % max(1, len(cuts)), True, doc_id, z))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["block", "tail", "doc_id", "z"])

    return run


FOUND = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
PAIRS = pa.schema([*FOUND, *(pa.field(c, pa.int64()) for c in ("id", "raw", "next_id", "next_raw"))])
FOUND_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(digits: int):
    """Of rows in order, each with the one behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for block, tail, doc_id, z in zip(*(batch.column(c).to_pylist() for c in ("block", "tail", "doc_id", "z"))):
                text = zstandard.decompress(z).decode("utf-8", "surrogatepass")
                canon, raw = canonical(text), raw_hash(text)
                if before and before[0] == block and not before[1]:
                    _, _, own_id, own, own_canon, own_raw = before
                    edited = edit(own, text)
                    edited_canon = canonical(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own_id, len(own), sha, digest(own_canon, digits), digest(edited_canon, digits), float(own_canon == edited_canon), float(own_canon == canon), own_id or 0, own_raw, doc_id or 0, raw))
                before = (block, tail, doc_id, text, canon, raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(PAIRS), PAIRS)], schema=PAIRS)

    return run


def fingerprints(docs: DataFrame, digits: int = 32) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is that of the next smaller doc_id, after the last the first. Rows that repeat a doc_id follow each
    other in the order of their packed text; rows without doc_id come last. Null texts count as empty. A table of one row
    is its own next document, an empty one gives an empty one. Other columns, whatever their names, are not read. All texts
    and edited texts of one digest are compared byte by byte.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = buckets_for(docs, BLOCK_BYTES, 1.0)
    cuts = _cuts(given, blocks)
    dealt = given.mapInArrow(_deal(cuts, blocks), "block int, tail boolean, doc_id long, z binary")
    ordered = dealt.repartitionById(max(1, len(cuts)), F.col("block")).sortWithinPartitions(F.col("block"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("z"))
    found = stash(ordered.mapInArrow(_pairs(digits), FOUND_DDL + ", id long, raw long, next_id long, next_raw long"))
    clashes = collisions(found, given, digits)
    if not clashes.isEmpty():
        found = _resolve(_resolve(found, clashes, "fingerprint", ["id", "raw"]), clashes, "edited_fingerprint", ["id", "raw", "next_id", "next_raw"])
    return found.select(*FOUND.names)


def with_raw(given: DataFrame) -> DataFrame:
    """(id, raw, text) of each row, as _pairs() names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [i or 0 for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([raw_hash(t) for t in texts], pa.int64()), pa.array(texts, pa.string())], names=["id", "raw", "text"])

    return given.mapInArrow(run, "id long, raw long, text string")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
