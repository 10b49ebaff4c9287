"""Operator 9, removal of passages that an earlier document has: difference-cover anchors, extended to whole windows.

A window is WINDOW consecutive words of one document; a word goes if a window over it also starts in a document with a
smaller doc_id. Hashing all windows would shuffle a row a word. Instead COVER is a difference cover modulo PERIOD: for
any two places i and j some shift below PERIOD brings both to cover places. So two equal windows share an aligned anchor,
a run of WINDOW - PERIOD + 1 words that starts at a cover place in both documents, and only 3 of 7 places are hashed.

1. Anchors are grouped in each map task. One that two documents of a task hold is known to repeat at once; of every
   other one a single entry is shuffled. So a hash never gets more entries than there are map tasks, however many
   documents hold the passage, and nothing grows with the square of a group.
2. Anchors that repeat are extended: only the windows over them are hashed (128 bits) and grouped the same way, and
   the smallest doc_id of each is found. All entries but those of the smallest document are removed.

Entries travel packed by hash bucket; a bucket's size is bounded by the number of buckets, which follows the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, as_bytes, buckets_for, by_bucket, ngram_hashes, table

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Entries a task holds before it groups and sends them.
FLUSH = 400_000
#: Bytes of entries a bucket should have at most.
BUCKET_BYTES = 96 << 20

#: An entry of the first round: the anchor's hash, the row it is in (its doc_id, and 63 bits of its text's hash in case others
#: have that too), its place. KNOWN marks a hash known to repeat. Only 56 bits of the anchor's hash travel: it is a filter.
ANCHOR_ENTRY = np.dtype([("h", "<u8"), ("doc", "<i8"), ("salt", "<i8"), ("at", "<u4")])
KNOWN = 0xFFFFFFFF
#: One of the second round, with 96 bits of the window's hash.
WINDOW_ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("salt", "<i8"), ("at", "<u4")])

#: What either round settles: places of rows.
PLACE = np.dtype([("doc", "<i8"), ("salt", "<i8"), ("at", "<u4")])

PACKED = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("settled", pa.binary())])
PACKED_DDL = "bucket int, entries binary, settled binary"
PLACES = pa.schema([("key", pa.int64()), ("salt", pa.int64()), ("places", pa.binary())])
PLACES_DDL = "key long not null, salt long not null, places binary"


def _planes(column: np.ndarray) -> np.ndarray:
    """The bytes of a column, first bytes first: the high ones of small numbers compress to nothing."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T


def _pack(e: np.ndarray) -> bytes:
    """Entries in order of documents: the hashes as they are, the rest compressed."""
    e = e[np.lexsort((e["at"], e["doc"]))]
    skip = int(e.dtype == ANCHOR_ENTRY)
    hashes = [_planes(e[f])[skip:] for f in e.dtype.names if f in "hg"]
    rest = [_planes(e[f]) for f in e.dtype.names if f not in "hg"]
    return len(e).to_bytes(4, "little") + b"".join(x.tobytes() for x in hashes) + zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in rest))


def _unpack(packed: bytes, kind: np.dtype) -> np.ndarray:
    n, at, skip = int.from_bytes(packed[:4], "little"), 4, int(kind == ANCHOR_ENTRY)
    out = np.zeros(n, kind)
    names = [*(f for f in kind.names if f in "hg"), *(f for f in kind.names if f not in "hg")]
    head = sum(kind[f].itemsize - skip for f in names if f in "hg") * n
    data = packed[4 : 4 + head] + zstandard.decompress(packed[4 + head :])
    at = 0
    for f in names:
        size = kind[f].itemsize
        bytes_ = np.zeros((size, n), np.uint8)
        low = skip if f in "hg" else 0
        bytes_[low:] = np.frombuffer(data, np.uint8, (size - low) * n, at).reshape(size - low, n)
        out[f] = np.ascontiguousarray(bytes_.T).view(kind[f]).ravel()
        at += (size - low) * n
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _dealt(entries: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    starts = [*_runs(bucket), len(bucket)]
    for i, j in zip(starts, starts[1:]):
        yield int(bucket[i]), _pack(entries[i:j])


def _send(entries: np.ndarray, settled: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries by hash bucket, and places that need no other task's word, by row."""
    rows = [(b, x, None) for b, x in _dealt(entries, (entries["h"] >> np.uint64(20)) % np.uint64(buckets))]
    rows += [(b, None, x) for b, x in _dealt(settled, settled["doc"] % buckets)]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 3, PACKED)], schema=PACKED)


def _place(e: np.ndarray) -> np.ndarray:
    out = np.empty(len(e), PLACE)
    for f in PLACE.names:
        out[f] = e[f]
    return out


def repeated_anchors(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries in runs of equal hashes, for each whether another row holds its hash or it is known to repeat)."""
    e = e[np.argsort(e["h"], kind="stable")]
    starts = _runs(e["h"])
    if not len(starts):
        return e, np.empty(0, bool)
    again = np.maximum.reduceat(e["at"], starts) == KNOWN
    for f in ("doc", "salt"):
        again |= np.minimum.reduceat(e[f], starts) != np.maximum.reduceat(e[f], starts)
    return e, np.repeat(again, np.diff([*starts, len(e)]))


def later_windows(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries in runs of equal hashes, for each whether a smaller document holds its hash)."""
    e = e[np.lexsort((e["g"], e["h"]))]
    starts = _runs(e["h"], e["g"])
    if not len(starts):
        return e, np.empty(0, bool)
    return e, e["doc"] > np.repeat(np.minimum.reduceat(e["doc"], starts), np.diff([*starts, len(e)]))


def _anchor_round(buckets: int):
    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(parts)
        parts.clear()
        e, again = repeated_anchors(e)
        known = e[again][_runs(e["h"][again])].copy() if again.any() else e[:0].copy()
        known["at"] = KNOWN
        yield from _send(np.concatenate([e[~again], known]), _place(e[again]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, parts, held = WordHash(), [], 0
        for batch in batches:
            for key, salt, text in zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), as_bytes(batch.column("text"))):
                words = text.split() if text else []
                if len(words) < WINDOW:
                    continue
                hashes = ngram_hashes(cache.array(words), ANCHOR)
                cache.trim()
                at = np.arange(len(hashes), dtype=np.uint32)
                at = at[np.isin(at % PERIOD, COVER)]
                e = np.empty(len(at), ANCHOR_ENTRY)
                e["h"], e["doc"], e["salt"], e["at"] = hashes[at], key, salt, at
                parts.append(e)
                held += len(e)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _settle(kind: np.dtype, rule, buckets: int):
    """Of each bucket the places that its rule marks, by row, and those that came settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(entries: list) -> list[tuple[int, bytes]]:
            if not entries:
                return []
            e = np.concatenate(entries)
            entries.clear()
            e, marked = rule(e)
            if kind is ANCHOR_ENTRY:
                marked &= e["at"] != KNOWN
            found = _place(e[marked])
            return list(_dealt(found, found["doc"] % buckets))

        def send(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "settled"])

        held, at = [], None
        for batch in batches:
            out = []
            for bucket, entries, settled in zip(*(batch.column(c).to_pylist() for c in PACKED.names)):
                if bucket != at:
                    out += close(held)
                    held, at = [], bucket
                if entries is None:
                    out.append((bucket, settled))
                else:
                    held.append(_unpack(entries, kind))
            yield send(out)
        yield send(close(held))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, salt, places): one row for each row with settled places. A bucket holds whole rows."""

    def close(settled: list) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([_unpack(x, PLACE) for x in settled]) if settled else np.empty(0, PLACE)
        e = e[np.lexsort((e["at"], e["doc"]))]
        if ((e["doc"][1:] == e["doc"][:-1]) & (e["salt"][1:] != e["salt"][:-1])).any():  # rows that share a doc_id
            e = e[np.lexsort((e["at"], e["salt"], e["doc"]))]
        at, starts = np.ascontiguousarray(e["at"]), [*_runs(e["doc"], e["salt"]), len(e)]
        rows = [(int(e["doc"][i]), int(e["salt"][i]), at[i:j].tobytes()) for i, j in zip(starts, starts[1:])]
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2000]), PLACES)], schema=PLACES)

    held, at = [], None
    for batch in batches:
        for bucket, settled in zip(batch.column("bucket").to_pylist(), batch.column("settled").to_pylist()):
            if bucket != at:
                yield from close(held)
                held, at = [], bucket
            held.append(settled)
    yield from close(held)


def _window_round(buckets: int):
    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(parts)
        parts.clear()
        e, later = later_windows(e)
        yield from _send(e[~later], _place(e[later]), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other, parts, held = WordHash(1), WordHash(2), [], 0
        for batch in batches:
            for doc, salt, z, marked in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "z", "marked"))):
                words = zstandard.decompress(z).split()
                last = len(words) - WINDOW
                anchors = np.unique(np.frombuffer(marked, np.uint32)).astype(np.int64)
                at = np.unique((anchors[:, None] - np.arange(PERIOD)[None, :]).ravel())
                at = at[(at >= 0) & (at <= last)]
                e = np.empty(len(at), WINDOW_ENTRY)
                e["h"], e["g"] = ngram_hashes(one.array(words), WINDOW)[at], ngram_hashes(other.array(words), WINDOW, 0xC2B2AE3D27D4EB4F)[at] >> np.uint64(32)
                e["doc"], e["salt"], e["at"] = doc, salt, at
                one.trim(), other.trim()
                parts.append(e)
                held += len(e)
                if held >= FLUSH // 2:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [pack.compress(x or b"") for x in as_bytes(batch.column("text"))]
        carried = [batch.column(c) for c in batch.schema.names if c == "rest"]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("salt"), pa.array(z, pa.binary()), *carried], names=["key", "salt", "z"] + ["rest"] * len(carried))


def _cut(keep_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, salt, z, gone in zip(*(batch.column(c).to_pylist() for c in ("key", "salt", "z", "gone"))):
                text = zstandard.decompress(z)
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int32)
                if gone:
                    at = np.unique(np.frombuffer(gone, np.uint32)).astype(np.int64)
                    cover[at] += 1
                    cover[:-1] -= np.bincount(at + WINDOW, minlength=len(words) + 1)[: len(words)].astype(np.int32)
                keep = np.cumsum(cover)[: len(words)] == 0
                kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
                joined = b" ".join(kept)
                row = (None if salt < 0 else doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest())
                out.append((*row, (text if len(kept) == len(words) else joined).decode("utf-8", "replace")) if keep_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]
            carried = [batch.column(c) for c in batch.schema.names if c == "rest"]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)), *carried], names=names + ["rest"] * len(carried))

    return run


def cut_repeats(docs: DataFrame, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, n_words, n_removed, kept_sha256 [, text]), a row for each row.

    With keep_text also what is left: the text as it was where nothing goes, else the kept words joined by one space.
    carry names columns to be handed through, as the fields of a struct `rest`.
    Null texts count as empty: no words, nothing removed. A row with a null doc_id is neither earlier nor later than any
    other: nothing of it goes, and it takes nothing from others. Rows that repeat a doc_id are one document: they take
    nothing from each other. Texts below 13 words stay whole. Other columns are not read; an empty table gives an empty one.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    salt = F.when(doc_id.isNull(), -1).otherwise(F.shiftrightunsigned(F.xxhash64(text), 1)).cast("long")
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("rest")] if carry else []
    given = docs.select(F.coalesce(doc_id, F.lit(0)).alias("key"), salt.alias("salt"), text.alias("text"), *rest)
    with_rest = f", rest {given.schema['rest'].dataType.simpleString()}" if carry else ""
    n = buckets_for(docs, BUCKET_BYTES, 3.0)
    packed = given.mapInArrow(_compress, "key long not null, salt long not null, z binary not null" + with_rest)

    def round_of(entries: DataFrame, kind: np.dtype, rule) -> DataFrame:
        settled = by_bucket(entries, n).mapInArrow(_settle(kind, rule, n), "bucket int, settled binary")
        return by_bucket(settled, n).mapInArrow(_gather, PLACES_DDL)

    marked = round_of(given.where("salt >= 0 and text is not null").select("key", "salt", "text").mapInArrow(_anchor_round(n), PACKED_DDL), ANCHOR_ENTRY, repeated_anchors).withColumnRenamed("places", "marked")
    gone = round_of(packed.join(marked, ["key", "salt"]).mapInArrow(_window_round(n), PACKED_DDL), WINDOW_ENTRY, later_windows).withColumnRenamed("places", "gone")
    cut = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text + with_rest
    return packed.join(gone, ["key", "salt"], "left").mapInArrow(_cut(keep_text), cut)


def documents_without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeats cut from text, and n_chars to match where there is such a column; other columns as they are.

    A row a row, in any order. Null texts stay null, texts without repeats stay as they are, a text of nothing but repeats
    becomes empty; rows without doc_id stay whole, rows that repeat a doc_id take nothing from each other (cut_repeats()). An
    empty table gives an empty one. Columns of docs may have any names but __null.
    """
    other, kinds = tuple(c for c in docs.columns if c not in ("doc_id", "text")), docs.schema
    cut = cut_repeats(docs.withColumn("__null", F.col("text").isNull()), True, (*other, "__null"))
    text = F.when(~F.col("rest.__null"), F.col("text"))
    new = {"doc_id": F.col("doc_id").cast(kinds["doc_id"].dataType), "text": text}
    new |= {c: F.col(f"rest.`{c}`") for c in other}
    if "n_chars" in other:
        new["n_chars"] = F.when(~F.col("rest.__null"), F.length("text")).otherwise(F.col("rest.n_chars")).cast(kinds["n_chars"].dataType)
    return cut.select(*(new[c].alias(c) for c in docs.columns))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
