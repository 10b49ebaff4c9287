"""Operator 7, near duplicates of documents: circulant MinHash, banding, exact Jaccard verification.

A document's set holds its distinct shingles of five words. Two permutations of the 32-bit integers give the whole
signature: coordinate k is the least value of PI(SIGMA(x) + k) over the set, so PI is used K times, circularly shifted.

1. Documents with one and the same set form a class, which its smallest doc_id stands for; only these go on.
2. Bands of the signature give bucket keys. The smallest member of a bucket is its hub; a document's hubs are those of its
   buckets, so documents that share a bucket share a hub. Buckets are never gathered.
3. Each document is confirmed, on the full sets, against the hub that it shares most buckets with: a pair a document. The
   links give components, and a large group of near copies is mostly one.
4. Where members of one hub still lie in several components, their sets are compared across these, in blocks of bounded
   size: sizes and sketches (a byte a coordinate) first, then the exact intersections of all pairs that are left. Members
   in the hub's own component are not compared with each other. A block gives a row a component that it joins, never a row
   a pair; with these links the components are final.

So each pair that shares a bucket is either known to lie in one component already or is compared itself. A set's elements
are 64-bit hashes of its shingles, all of them.
With 24 bands of 4 rows, a pair at a similarity of 0.75 shares a bucket with probability 0.9999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, as_bytes, drop, mix64, ngram_hashes, stash, table
from .components import components

SHINGLE = 5
ROWS, BANDS = 4, 24
COORDINATES = ROWS * BANDS
#: Sketch bytes that must agree before a late pair is compared in full; five standard deviations below 0.75 of 96.
LEAST_AGREE = 50
#: Members of a group that are compared with as many others at once, the shingles they may have in all, and the shingles
#: that are counted at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 500_000, 4096

SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary, z binary"


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased (bytes.split knows just these six separators)."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    """The document's set as sorted distinct 64-bit hashes."""
    if not words:
        return np.empty(0, np.uint64)
    h = cache.array(words)
    if len(words) < SHINGLE:
        return ngram_hashes(h, len(words)) ^ np.uint64(len(words))
    return np.unique(ngram_hashes(h, SHINGLE))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """In place: a bijection of the 32-bit integers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_minhash(shingles: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The signature: size coordinates of 32 bits."""
    x = _permute((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)  # SIGMA
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, _permute(x[None, at : at + 1024] + shift, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)  # PI
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key a band; the band's number is part of it."""
    pairs = np.ascontiguousarray(signature).view(np.uint64).reshape(BANDS, ROWS // 2)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in range(ROWS // 2):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + pairs[:, column])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, pack = WordHash(), zstandard.ZstdCompressor(level=3)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("z", pa.binary())])
    for batch in batches:
        ids, out = batch.column("doc_id").to_pylist(), []
        for doc_id, text in zip(ids, as_bytes(batch.column("text"))):
            words = words_of(text)
            shingles = shingle_hashes(words, cache)
            cache.trim()
            if not len(shingles) or doc_id is None:
                out.append((doc_id, len(shingles), None, None, None, None))
                continue
            signature = circulant_minhash(shingles)
            sketch = (signature & np.uint32(0xFF)).astype(np.uint8).tobytes()
            out.append((doc_id, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), band_keys(signature), sketch, pack.compress(b" ".join(words))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch, z) of each row; the last four null without words or doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign, SIGNED)


def _full_set(z: bytes, cache: WordHash) -> np.ndarray:
    """The set of a document from its packed words: all its distinct shingles, as sorted 64-bit hashes."""
    out = shingle_hashes(zstandard.decompress(z).split(b" "), cache)
    cache.trim()
    return out


def _alike(both, one, other, percent: int):
    """Whether sets of sizes one and other, with so many elements in common, are to be linked."""
    return 100 * both >= percent * (one + other - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last = WordHash(), (None, None)
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for za, zb in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist()):
                if zb != last[0]:
                    last = (zb, _full_set(zb, cache))
                one, other = _full_set(za, cache), last[1]
                keep.append(_alike(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    first = pairs.join(reps.select(F.col("rep").alias("a"), F.col("z").alias("za")), "a")
    return first.join(reps.select(F.col("rep").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb").mapInArrow(_confirm(percent), "a long, b long")


def _common(one: list[np.ndarray], other: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """For the wanted pairs (i, j) the number of elements that one[i] and other[j] have in common; 0 for the rest.

    Elements that only one of the sets has are left out; of the others a product of two 0/1 matrices gives all counts at
    once, some columns at a time. Where few pairs are wanted, they are intersected one by one.
    """
    out = np.zeros(wanted.shape, np.int64)
    at_i, at_j = np.nonzero(wanted)
    if not len(at_i):
        return out
    rows, columns = np.unique(at_i), np.unique(at_j)
    sizes = [len(one[i]) for i in rows], [len(other[j]) for j in columns]
    if len(at_i) <= 4 * (len(rows) + len(columns)):
        for i, j in zip(at_i, at_j):
            out[i, j] = len(np.intersect1d(one[i], other[j], assume_unique=True))
        return out
    elements = np.concatenate([*(one[i] for i in rows), *(other[j] for j in columns)])
    owner = np.repeat(np.arange(len(rows) + len(columns)), sizes[0] + sizes[1])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    new = np.concatenate([[True], elements[1:] != elements[:-1]])
    column = np.cumsum(new) - 1
    shared = (np.bincount(column) > 1)[column]
    column, owner = np.cumsum(new & shared)[shared] - 1, owner[shared]  # elements in order, so columns are too
    got = np.zeros((len(rows), len(columns)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(rows) + len(columns), COLUMNS), np.float32)  # counts stay below 2 ** 24: exact
        held[owner[lo:hi], column[lo:hi] - start] = 1
        got += (held[: len(rows)] @ held[len(rows) :].T).astype(np.int64)
    out[np.ix_(rows, columns)] = got
    return np.where(wanted, out, 0)


def _spanning(components: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(component, least component joined to it) from links between members i and j: a row a component, not a row a link."""
    names, at = np.unique(components, return_inverse=True)
    root = np.arange(len(names))
    while True:
        low, new = np.minimum(root[at[i]], root[at[j]]), root.copy()
        np.minimum.at(new, at[i], low)
        np.minimum.at(new, at[j], low)
        new = new[new]
        if (new == root).all():
            return [(int(names[k]), int(names[r])) for k, r in enumerate(root) if k != r]
        root = new


def _block_links(percent: int):
    """Rows (hub, bi, bj, block, component, n_shingles, sketch, z), those of equal (hub, bi, bj) together: links that join components."""
    names = ("block", "component", "n_shingles", "sketch", "z", "hub", "bi", "bj")

    def links(rows: dict, cache: WordHash) -> pa.RecordBatch:
        comp, size, block = (np.array(rows[c], np.int64) for c in ("component", "n_shingles", "block"))
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(comp), COORDINATES)
        one, other = np.flatnonzero(block == rows["bi"][0]), np.flatnonzero(block == rows["bj"][0])
        wanted = comp[one][:, None] != comp[other][None, :]
        wanted &= 100 * np.minimum(size[one][:, None], size[other][None, :]) >= percent * np.maximum(size[one][:, None], size[other][None, :])
        if rows["bi"][0] == rows["bj"][0]:
            wanted = np.triu(wanted, 1)
        if wanted.any():
            agree = np.zeros(wanted.shape, np.uint8)
            for k in range(COORDINATES):
                agree += sketch[one, k][:, None] == sketch[other, k][None, :]
            wanted &= agree >= LEAST_AGREE
        used = np.zeros(len(comp), bool)
        used[one[wanted.any(axis=1)]] = used[other[wanted.any(axis=0)]] = True
        sets = {k: _full_set(rows["z"][k], cache) for k in np.flatnonzero(used)}
        none = np.empty(0, np.uint64)
        both = _common([sets.get(k, none) for k in one], [sets.get(k, none) for k in other], wanted)
        i, j = np.nonzero(wanted & _alike(both, size[one][:, None], size[other][None, :], percent))
        found = _spanning(comp, one[i], other[j]) if len(i) else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, cache = {n: [] for n in names}, None, WordHash()
        for batch in batches:
            columns, start = {n: batch.column(n).to_pylist() for n in names}, 0
            group = list(zip(columns["hub"], columns["bi"], columns["bj"]))
            for i, g in enumerate([*group, None]):
                if i == len(group) or g != at:
                    for n in names:
                        held[n] += columns[n][start:i]
                    start = i
                    if i < len(group):
                        if len(held["block"]) > 1:
                            yield links(held, cache)
                        held, at = {n: [] for n in names}, g
        if len(held["block"]) > 1:
            yield links(held, cache)

    return run


def _late_links(members: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """members (rep, hub, compared): links (a, b) between components, of members of one hub that lie in different ones.

    Members that lie in the hub's component are settled with each other; blocks of the rest are compared with each other and
    with the blocks of the settled ones.
    """
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = named.join(texts.select("rep", "n_shingles"), "rep")
    each = sizes.groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.max(F.col("rep") == F.col("hub")).alias("settled"), F.min("compared").alias("compared"))
    of = lambda settled, column: F.sum(F.when(F.col("settled") == settled, F.col(column)).otherwise(0))
    open_ = F.max(~F.col("settled") & ~F.col("compared"))
    sums = each.groupBy("hub").agg(of(False, "n").alias("n_rest"), of(False, "s").alias("s_rest"), of(True, "n").alias("n_settled"), of(True, "s").alias("s_settled"), open_.alias("open"), F.max(F.when(F.col("settled"), F.col("component"))).alias("settled"))
    sums = sums.where("n_rest > 0 and (open or n_rest + n_settled > 2)")  # else the hub and one member, compared already
    blocks = lambda n, s: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(s) / BLOCK_SHINGLES)).cast("int")
    rows = named.join(sums.select("hub", "settled", blocks("n_rest", "s_rest").alias("r"), blocks("n_settled", "s_settled").alias("t")), "hub")
    rows = rows.withColumn("rest", F.col("component") != F.col("settled")).join(texts, "rep")
    dealt = F.xxhash64("rep")
    rows = rows.withColumn("block", F.when(F.col("rest"), F.pmod(dealt, F.col("r"))).otherwise(F.col("r") + F.pmod(dealt, F.col("t"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("r") + F.col("t")).otherwise(F.col("r")) - 1)))
    rows = rows.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    dealt = rows.select("hub", "bi", "bj", "block", "component", "n_shingles", "sketch", "z").repartition("hub", "bi", "bj").sortWithinPartitions("hub", "bi", "bj")
    return dealt.mapInArrow(_block_links(percent), "a long, b long").distinct()


def _same_ids(with_set: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between a doc_id that several rows of different sets have, and the classes of these."""
    several = with_set.groupBy("doc_id").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least <> most").select("doc_id")
    return with_set.join(several, "doc_id").select("doc_id", "set_id").join(classes, "set_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, n_shingles, component_id, kept), a row for each row.

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; component_id is the smallest
    doc_id reachable, kept whether it is the row's own. Null or empty texts have n_shingles 0, link with nothing and are
    kept. Rows with a null doc_id link with nothing: component_id null, kept. Rows that repeat a doc_id are one document,
    linked wherever one of them is. Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    signed = stash(sign(docs))
    with_set = signed.where("set_id is not null")
    classes = stash(with_set.groupBy("set_id").agg(F.min("doc_id").alias("rep")))

    keys = with_set.select("set_id", "doc_id", "bands").join(classes, "set_id").where("doc_id = rep").select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("key", "hub")
    met = stash(keys.join(shared, "key").groupBy("rep", "hub").agg(F.count("*").alias("bands")))
    most = met.where("rep <> hub").groupBy("rep").agg(F.max(F.struct("bands", (-F.col("hub")).alias("hub"))).alias("most")).select("rep", (-F.col("most.hub")).alias("nearest"))
    members = met.join(most, "rep", "left").select("rep", "hub", F.coalesce(F.col("hub") == F.col("nearest"), F.lit(False)).alias("compared"))
    texts = with_set.select("set_id", F.col("doc_id").alias("rep"), "n_shingles", "sketch", "z").join(classes, ["set_id", "rep"], "left_semi").join(met, "rep", "left_semi")
    texts = stash(texts.select("rep", "n_shingles", "sketch", "z"))

    links = _same_ids(with_set, classes).unionAll(confirm(members.where("compared").select(F.col("rep").alias("a"), F.col("hub").alias("b")), texts, percent))
    links = stash(links)
    labels = components(links)
    late = stash(_late_links(members, labels, texts, percent))
    if not late.isEmpty():
        labels = components(links.unionAll(late))
    for spent in (met, texts, links, late):
        drop(spent)
    of_set = classes.join(labels, classes.rep == labels.node, "left").select("set_id", F.coalesce("component", "rep").alias("of_set"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("of_set", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep; all columns stay as they are.

    Null and empty texts stay, and rows without doc_id. Rows that repeat a doc_id are one document: all stay or all go. An
    empty table gives an empty one. Columns of docs may have any names but __gone.
    """
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
