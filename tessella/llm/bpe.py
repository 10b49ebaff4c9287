"""Operator 6, byte-level BPE encoding and decoding over a contiguous array of ranks.

A piece of text (the pre-tokeniser's word) starts as single bytes. Beside the parts stands one array with the rank of
each adjacent pair. The least rank is found by a scan, the boundary between its two parts is deleted, and only the two
ranks beside it are looked up anew, until no pair has a rank. Words are short, so the scan beats any queue; runs of over
LONG_WORD bytes (junk without blanks) use a heap with the same order (rank, then place), so that they stay n log n.

Encoded words are remembered, as a text repeats few of them; the memory is bounded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .memo import Memo

#: Bytes of a word above which the heap takes over from the scan.
LONG_WORD = 200
#: Words a worker remembers, in each of two generations.
WORDS = 200_000
NO_RANK = sys.maxsize
#: The pattern that byte-level pre-tokenisers split by (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Texts to ids, as little-endian 32-bit integers, and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = _byte_of_char()
        raw = lambda s: bytes(back[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}  # of a pair of ids, as one integer
        self.merged: list[int] = []  # the id that a rank's pair becomes
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            self.rank.setdefault(ids[a] << 32 | ids[b], r)
            self.merged.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words, self.runs = regex.compile(PATTERN), regex.compile(r"\s\s")
        self.piece = Memo(self._piece, WORDS // 2)
        self.blank = Memo(lambda chunk: self._pieces(" " + chunk), WORDS)

    def _piece(self, piece: str) -> bytes:
        return struct.pack(f"<{len(ids := self.merge(piece.encode()))}I", *ids)

    def merge(self, word: bytes) -> list[int]:
        """The word's ids."""
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        single, rank, merged = self.single, self.rank.get, self.merged
        parts = [single[b] for b in word]
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            new = parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], NO_RANK)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        n, rank = len(word), self.rank.get
        parts = [self.single[b] for b in word]
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], bytearray(n)
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or rank(parts[i] << 32 | parts[j]) != r:
                continue  # one of the two has been merged since
            parts[i], gone[j], after[i] = self.merged[r], 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p, x in zip(parts, gone) if not x]

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.words.findall(text)))

    def _plain(self, text: str) -> bytes:
        """Where no two blanks meet, no piece reaches over a blank but at its start: the text falls apart there."""
        if self.runs.search(text):
            return self._pieces(text)
        first, *others = text.split(" ")
        return self._pieces(first) + b"".join(map(self.blank.__getitem__, others))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; strings of special tokens become their ids."""
        self.piece.trim(), self.blank.trim()
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _encode(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = e.encode(text or "")
                decoded = e.decode(ids)
                out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) + ((np.frombuffer(ids, "<u4"), decoded) if keep_ids else ()))
            kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int64()), "decoded": pa.string()} if keep_ids else {})
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    return run


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]), a row for each row.

    vocabulary: the path of a byte-level BPE file in the tokenizers' JSON format, on every worker. Null texts count as
    empty: no ids. Rows that repeat a doc_id, or have none, are encoded each for itself. Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(vocabulary, keep_ids), schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
