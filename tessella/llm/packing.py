"""Operator 10, packing of documents into windows of tokens with a controlled mixture of sources.

Each source is a queue of tokens (its documents one behind the other). A window is one round of deficit round-robin: a
queue earns `window * share` tokens of credit a round and is served whole tokens; the fraction that is left, its deficit,
is carried into the next round. What queues 0..s have been served after w rounds together is floor(w * window * P_s), with
P_s the sum of their shares, so a queue's deficit before any window is known without playing the rounds before it: it
carries over windows and over partitions alike, every window is full, and no queue is ever more than one token off.
Shares are the queues' parts of all tokens, so all queues run dry together and only the last window is short.

In whole tokens this needs a queue that earns a token a window at least. Sources that earn less are rounds of their own within
a queue that they fill together: sources of like size (within a factor of two) are one group, and a group is served by the
same rule, in rounds of its own that are long enough for the smallest of them to earn a token in each and for the largest to
earn QUANTUM (so that documents are not cut into single tokens). So every source is a queue with a deficit that is carried, however small; what differs is over how many windows it comes to whole tokens.
Groups that together earn less than a token a window are joined with the next smaller sources, and the last ones with the
smallest large source. Nothing about sources is held in one place but the large ones (at most `window`) and the groups.

1. Documents are tokenised; ids are kept as 16-bit integers where the vocabulary allows.
2. A document's place in its queue: documents are dealt to blocks by a hash, running sums within a block and queue, and
   the sums of whole blocks before it. No source, however large, meets in one task.
3. Each document cuts itself along the windows, with no knowledge of any other.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, stash, table
from .bpe import _byte_of_char
from .memo import Known

WINDOW = 2048
#: The id behind each document.
END = 1
#: Tokens that the largest source of a group earns at least in a round of the group.
QUANTUM = 64
#: Parts that the sources of a group are summed up in.
PARTS = 1024
#: Words a worker remembers before it starts again.
WORDS = 500_000
#: Bytes of ids that a block should have at most.
BLOCK_BYTES = 256 << 20
#: The pattern that the word-level pre-tokeniser keeps (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Marks that are a piece of their own behind a word.
MARKS = frozenset(".,!?;:")


class WordTokenizer:
    """ids of a text as the tokenizers library gives them for a lower-casing word BPE, each word asked for once.

    The format normalises (NFC, lower case) and drops white space before it splits, and none of its pieces reaches over a
    blank, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model, self.kind = tokenizer.model, "<u2" if tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.letter = "H" if self.kind == "<u2" else "I"
        self.special = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.end = np.array([END], self.kind).tobytes()
        self.split = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.shown = {b: c for c, b in _byte_of_char().items()}
        self.pieces, self.piece, self.word = regex.compile(PATTERN), Known(self._piece, WORDS // 2), Known(self._word, WORDS)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalpha() else "".join(self.shown[b] for b in piece.encode())
        return array(self.letter, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            word = word.lower()
            if word.isalpha():  # one piece
                return self.piece[word]
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self.piece[word[:-1]] + self.piece[word[-1:]]
        else:
            word = unicodedata.normalize("NFC", word)
            word = word.lower() if "\u03a3" not in word else "".join(c.lower() for c in word)  # a final sigma is no other letter here
            if word.isalpha() and max(word) < "\u0250":  # Latin letters, whatever the table of Unicode
                return self.piece[word]
        return b"".join(map(self.piece.__getitem__, self.pieces.findall(word)))

    def _plain(self, text: bytes) -> bytes:
        return b"".join([self.word[w.decode()] for w in text.split()])

    def encode(self, text: bytes) -> bytes:
        self.piece.trim(), self.word.trim()
        if not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), array(self.letter, [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


    def encode_column(self, texts: pa.Array) -> pa.Array:
        """encode() of each text and the closing id, packed. The words of all texts are told apart at once, and each is asked for once."""
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        packed = [*map(self.word.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), self.end]
        self.piece.trim(), self.word.trim()
        at = np.diff(words.offsets.to_numpy())  # words of each text
        order = np.full(len(coded) + len(texts), len(packed) - 1, np.int32)  # of all texts, with the closing id behind each
        order[np.arange(len(coded)) + np.repeat(np.arange(len(texts)), at)] = coded.indices.to_numpy()
        size = np.fromiter(map(len, packed), np.int32, len(packed)) // len(self.end)
        starts, sizes = (np.cumsum(size) - size)[order], size[order]
        ends = np.cumsum(sizes)
        where = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)  # of each id, where it lies among the words' ids
        where += np.arange(len(where), dtype=np.int32)
        ids = np.frombuffer(b"".join(packed), self.kind)[where]
        bounds = np.concatenate([[0], ends[np.cumsum(at + 1) - 1]]) * len(self.end)
        out = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids)])
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token.decode()).to_numpy(zero_copy_only=False)
        if special.any():
            each = out.to_pylist()
            for i in np.flatnonzero(special):
                each[i] = self.encode(texts[int(i)].as_py().encode()) + self.end
            out = pa.array(each, pa.large_binary())
        return out


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            if len(batch):
                ids = t.encode_column(batch.column("text"))
                width = len(t.end)
                n = pc.divide(pc.binary_length(ids), width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), n, pa.array(np.full(len(batch), width, np.int32)), ids.cast(pa.binary())], names=["doc_id", "source", "n", "width", "ids"])

    return run


class Share:
    """A queue's part of a stream: `size` tokens of `total`, behind queues of `before` tokens, in rounds of `window` tokens.

    Plain integers, so that no sum is ever rounded. The queue must earn a token a round.
    """

    def __init__(self, before: int, size: int, total: int, window: int):
        self.before, self.size, self.total, self.window = before, size, total, window
        self.full = total // window

    def _served(self, upto: int, w: int) -> int:
        """Tokens that queues of upto tokens together get in the first w rounds."""
        return upto if w > self.full else w * self.window * upto // self.total

    def taken(self, w: int) -> int:
        """Tokens of this queue in the first w rounds."""
        return self._served(self.before + self.size, w) - self._served(self.before, w)

    def window_of(self, place: int) -> int:
        """The round that holds the queue's token."""
        w = min(self.full, place * self.total // (self.size * self.window))
        while w > 0 and self.taken(w) > place:
            w -= 1
        while self.taken(w + 1) <= place:
            w += 1
        return w

    def pieces(self, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(place among the n, length, round, offset there) of n tokens at a place of the queue."""
        done, w = 0, self.window_of(start)
        low, high = self._served(self.before, w), self._served(self.before + self.size, w)
        while done < n:
            w += 1
            next_low, next_high = self._served(self.before, w), self._served(self.before + self.size, w)
            at = start + done
            length = min(n - done, next_high - next_low - at)
            if length > 0:
                yield done, length, w - 1, next_low - low + at - (high - low)
                done += length
            low, high = next_low, next_high


def nested(inner: Share, outer: Share, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """pieces() of a source that is a queue of a group, which is a queue of the windows."""
    for done, length, w, offset in inner.pieces(start, n):
        for more, part, window, place in outer.pieces(w * inner.window + offset, length):
            yield done + more, part, window, place


PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(window: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("doc_id", "source", "start", "n", "width", "ids", *SHARE)
        kinds = PIECES | ({"ids": pa.list_(pa.int32()), "source": pa.string()} if keep else {})
        own, known = None, None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, source, start, n, width, ids, *share in zip(*(batch.column(c).to_pylist() for c in columns)):
                if share != known:
                    before, size, total, g_before, g_size, g_round = known = share
                    own = Share(before, size, total, window)
                    inner = g_size and Share(g_before, g_size, size, g_round)
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                raw = memoryview(wide.tobytes())
                for at, length, w, offset in nested(inner, own, start, n) if inner else own.pieces(start, n):
                    row = (doc_id, at, length, crc32(raw[4 * at : 4 * (at + length)]), n, w, offset)
                    out.append((*row, wide[at : at + length], source) if keep else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * len(kinds), kinds.values())], names=list(kinds))

    return run


#: Of each source's queue: where it stands among the windows' queues (before, size, total), and, for a source of a group,
#: where it stands in the group (of size tokens) and how long the group's rounds are.
SHARE = ("before", "size", "total", "g_before", "g_size", "g_round")


Level = tuple[int, int, int, int]


def groups_of(levels: list[Level], total: int, window: int) -> list[list[Level]]:
    """levels (number, tokens, least and most tokens of a source), joined in order until a group earns a token a window.

    What is left over goes to the last group; alone it is a group that does not earn one.
    """
    out: list[list[Level]] = []
    held: list[Level] = []
    for level in sorted(levels):
        held.append(level)
        if sum(x[1] for x in held) * window >= total:
            out.append(held)
            held = []
    if held:
        if out:
            out[-1] += held
        else:
            out.append(held)
    return out


def round_of(size: int, least: int, most: int) -> int:
    """A group's rounds: its smallest source earns a token in each, its largest QUANTUM of them."""
    return max(-(-size // least), QUANTUM * -(-size // most))


def queues(of_source: DataFrame, total: int, window: int) -> DataFrame:
    """of_source (source, n): (source, *SHARE) of each source."""
    spark = of_source.sparkSession
    level = F.when(F.col("n") * window >= total, -1).otherwise(F.floor(F.log2(F.lit(float(total)) / window / F.col("n")))).cast("int")
    leveled = stash(of_source.withColumn("level", F.greatest(level, F.lit(-1))))
    large = sorted((r["n"], r["source"]) for r in leveled.where(F.col("n") * window >= total).collect())  # at most `window` of them
    small = leveled.where(F.col("n") * window < total)
    sums = small.groupBy("level").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most")).collect()  # a level a power of two
    groups = groups_of([(r["level"], r["n"], r["least"], r["most"]) for r in sums], total, window)
    merged = large.pop(0) if len(groups) == 1 and large and sum(x[1] for x in groups[0]) * window < total else None
    rows, before, of_level, named = [], 0, {}, []
    for n, source in large:
        rows.append((source, before, n))
        before += n
    for g, levels in enumerate(groups):
        size = sum(x[1] for x in levels) + (merged[0] if merged else 0)
        of_level |= {x[0]: g for x in levels}
        named.append((g, before, size, round_of(size, min(x[2] for x in levels), max(x[3] for x in levels))))
        before += size
    big = spark.createDataFrame(rows, "source string, before long, size long")
    own = leveled.join(F.broadcast(big), "source").select("source", "before", "size", F.lit(total).cast("long").alias("total"), *(F.lit(None).cast("long").alias(c) for c in SHARE[3:]))
    if not groups:
        return own
    group = F.lit(None).cast("int")
    for number, g in of_level.items():
        group = F.when(F.col("level") == number, g).otherwise(group)
    members = small.withColumn("g", group)
    if merged:
        members = members.unionByName(leveled.where(F.col("source") == merged[1]).withColumn("g", F.lit(0)))
    members = members.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int"))
    ahead = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = members.groupBy("g", "part").agg(F.sum("n").alias("n")).select("g", "part", ahead("g", "part").alias("base"))
    members = members.withColumn("inner", ahead("g", "part", "source")).join(parts, ["g", "part"])
    of_group = F.broadcast(spark.createDataFrame(named, "g int, before long, size long, g_round long"))
    grouped = members.join(of_group, "g").select("source", "before", "size", F.lit(total).cast("long").alias("total"), (F.col("base") + F.col("inner")).alias("g_before"), F.col("n").alias("g_size"), "g_round")
    return own.unionByName(grouped)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """docs (doc_id, text, source, ...): a row for each piece, as (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset [, ids, source]).

    vocabulary: the path of a word BPE file in the tokenizers' JSON format, on every worker. Null and empty texts are
    documents of the closing id alone; a null source is a source of its own. Rows that repeat a doc_id are packed each for
    itself. Other columns, whatever their names, are not read. An empty table gives an empty one. Only the last sequence is short, and it is the only one to be padded.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text")]
    ids = stash(docs.select(*columns).mapInArrow(_tokenise(vocabulary), "doc_id long, source string, n long, width int, ids binary"))
    blocks = 4 * buckets_for(ids, BLOCK_BYTES)  # a block and a source make a group; several to a task even out

    total = ids.agg(F.sum("n")).first()[0] or 0
    of_queue = stash(queues(stash(ids.groupBy("source").agg(F.sum("n").alias("n"))), total, window))

    dealt = ids.withColumn("block", F.pmod(F.xxhash64("doc_id", "n", F.crc32("ids")), F.lit(blocks)).cast("int"))
    sums = dealt.groupBy("block", "source").agg(F.sum("n").alias("sum"))
    before = sums.withColumn("base", F.sum("sum").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "source", F.coalesce("base", F.lit(0)).alias("base"))
    order = Window.partitionBy("block", "source").orderBy("doc_id", "n", F.crc32("ids")).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("n").over(order), F.lit(0))).join(before, ["block", "source"]).join(of_queue, "source")
    placed = placed.select("doc_id", "source", (F.col("base") + F.col("inner")).alias("start"), "n", "width", "ids", *SHARE)
    return placed.mapInArrow(_cut(window, keep_ids), PIECES_DDL + ", ids array<int>, source string" * keep_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
