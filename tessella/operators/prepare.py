"""Deduplication, chunking and context preparation: the sequential operators, each bounded by a file, a text or a result.

These are order-dependent by definition, so they run as grouped Arrow functions over groups that are small by nature: the
records of one file, the pieces of one text, the results of one query.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import cached_property, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boundary_clean, citation, is_valid, normalized, strip
from ..sources.scratch import dealt, settled

SEPARATORS = ("\n\n", "\n", "! ", "? ", ". ", " ", "")


def exact_duplicates(docs: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """(order, content_hash, duplicate) of each row of docs: all but the first of each content are duplicates.

    Texts are hashed once and stay where they are. The first of each hash is found by an aggregation (combined before the
    shuffle) and joined back, so a content that very many rows share meets in no task.
    """
    hashed = settled(dealt(docs, order).select(order, F.md5(key.cast("binary")).alias("content_hash")))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("__first"))
    return hashed.join(first, "content_hash").select(order, "content_hash", (F.col(order) > F.col("__first")).alias("duplicate"))


def numbered(df: DataFrame, order: str, name: str = "i") -> DataFrame:
    """df with its rows numbered from 1 in the order of a column without ties: ranges are sorted apart, and each begins where
    the ones before it end, so no task holds all rows."""
    sorted_ = df.repartitionByRange(order).sortWithinPartitions(order)
    task = F.spark_partition_id()
    placed = settled(sorted_.withColumns({"__range": task, name: F.monotonically_increasing_id() - F.shiftleft(task.cast("long"), 33) + 1}))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n"))  # a row a range
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(before, "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two lower-cased texts; 0 if either is empty."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0


class Compared:
    """A text as it is compared: lower-cased, its characters counted once, and their places once it is the second of a pair."""

    def __init__(self, text: str):
        self.text = text.lower()
        self.counts = Counter(self.text)

    @cached_property
    def matcher(self) -> SequenceMatcher:
        return SequenceMatcher(None, "", self.text)


def near(a: Compared, b: Compared, threshold: float) -> bool:
    """ratio() of the texts >= threshold. Upper bounds are asked first, lengths and counts of characters; then SequenceMatcher's
    blocks are taken one at a time until the rest can't change the answer."""
    if not a.text or not b.text:
        return threshold <= 0
    length = len(a.text) + len(b.text)
    reaches = lambda matches: 2.0 * matches / length >= threshold
    if not reaches(min(len(a.text), len(b.text))):
        return False
    few, many = sorted((a.counts, b.counts), key=len)
    if not reaches(sum(min(n, many[c]) for c, n in few.items() if c in many)):
        return False
    b.matcher.set_seq1(a.text)
    matched, left, ranges = 0, min(len(a.text), len(b.text)), [(0, len(a.text), 0, len(b.text))]
    while ranges and reaches(matched + left) and not reaches(matched):
        a_from, a_to, b_from, b_to = ranges.pop()
        left -= min(a_to - a_from, b_to - b_from)
        i, j, n = b.matcher.find_longest_match(a_from, a_to, b_from, b_to)
        if n:
            matched += n
            for part in ((a_from, i, b_from, j), (i + n, a_to, j + n, b_to)):
                if (least := min(part[1] - part[0], part[3] - part[2])) > 0:
                    ranges.append(part)
                    left += least
    return reaches(matched)


def at_least(a: str, b: str, threshold: float) -> bool:
    """ratio(a, b) >= threshold."""
    return near(Compared(a), Compared(b), threshold)


def stored_and_compared(texts: pa.Array) -> pa.Array:
    """Texts normalised twice, and once more; together, as the second is made of the first."""
    stored = normalized(normalized(texts))
    return pa.StructArray.from_arrays([stored, normalized(stored)], names=["text", "compared"])


def preprocess(docs: DataFrame, group: str = "source", threshold: float = 0.85, window: int = 10) -> DataFrame:
    """docs (doc_id, group, text): what ingestion keeps of each file, as (group, doc_id, text, status).

    Texts are normalised twice; for the comparison with others they are once more, as normalising is not idempotent. status:
    invalid, exact (a kept text has the same hash), near (similar to one of the last `window` kept ones) or kept; in order of
    doc_id within a file.
    """
    forms = F.arrow_udf(stored_and_compared, "text string, compared string")(F.col("text").cast("string"))
    ready = dealt(docs.select(group, "doc_id", "text"), "doc_id").select(group, "doc_id", forms.alias("forms"))
    ready = ready.select(group, "doc_id", "forms.text", is_valid(F.col("forms.text")).alias("valid"), "forms.compared")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seen, last, status = pdf.sort_values("doc_id"), set(), [], []
        for text, compared, valid in zip(pdf["text"], pdf["compared"], pdf["valid"]):
            if not valid:
                status.append("invalid")
                continue
            if text in seen:
                status.append("exact")
                continue
            form = Compared(compared)
            if any(near(form, other, threshold) for other in last):
                status.append("near")
            else:
                status.append("kept")
                seen.add(text)
                last = [*last[-(window - 1) :], form]
        return pdf.assign(status=status)[[group, "doc_id", "text", "status"]]

    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
    return ready.groupBy(group).applyInPandas(walk, f"{group} {kinds[group]}, doc_id {kinds['doc_id']}, text string, status string")


def split_text(text: str, size: int = 512, overlap: int = 256, separators=SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that occurs, overlapping by at most `overlap`.

    A separator stays with the piece behind it. Parts that are still too long are cut at the next separators; the empty one
    cuts anywhere. Nothing but outer white space is lost.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, rest = separators[at], separators[at + 1 :]
    if separator:
        first, *others = text.split(separator)
        parts = [p for p in [first, *(separator + o for o in others)] if p]
    else:
        parts = list(text)
    out, held = [], []

    def flush() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    length = 0
    for part in parts:
        if len(part) > size and rest:
            flush()
            held, length = [], 0
            out += split_text(part, size, overlap, rest)
            continue
        if held and length + len(part) > size:
            flush()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    flush()
    return out


def merge_small(pieces: list[str], least: int = 256) -> list[str]:
    """Pieces joined by blanks until each has `least` characters; the last one may be shorter."""
    if len(pieces) < 2:
        return pieces
    out, held = [], ""
    for i, piece in enumerate(pieces):
        held = f"{held} {piece}" if held else piece
        if len(held) >= least or i == len(pieces) - 1:
            out.append(held)
            held = ""
    return out


def chunks(docs: DataFrame, size: int = 512, overlap: int = 256, least: int = 256, separators=SEPARATORS) -> DataFrame:
    """docs (doc_id, text): (doc_id, chunk_index, chunk_total, chunk), boundaries cleaned, empty chunks dropped.

    A document's chunks are one array until they are numbered, so nothing is shuffled.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            cut = [merge_small(split_text(t or "", size, overlap, separators), least) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cut, pa.list_(pa.string()))], names=["doc_id", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = dealt(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id").mapInArrow(run, f"doc_id {kind}, chunks array<string>")
    clean = cut.select("doc_id", F.filter(F.transform("chunks", boundary_clean), lambda c: c != "").alias("chunks"))
    return clean.select("doc_id", F.size("chunks").alias("chunk_total"), F.posexplode("chunks").alias("chunk_index", "chunk")).select("doc_id", "chunk_index", "chunk_total", "chunk")


#: Strategies of cutting; those that need a model fall back to the recursive one, with a warning.
STRATEGIES = {"recursive": chunks}
FALLS_BACK = ("semantic", "smart")


def strategy_used(strategy: str) -> str:
    """The strategy that cuts where this one is asked for."""
    if strategy in STRATEGIES:
        return strategy
    if strategy not in FALLS_BACK:
        raise ValueError(f"unknown strategy: {strategy}")
    warnings.warn(f"{strategy} chunking needs a model; the recursive one is used", stacklevel=3)
    return "recursive"


def chunked(docs: DataFrame, strategy: str = "recursive", **settings) -> DataFrame:
    """chunks() by the strategy's name; further strategies register themselves in STRATEGIES."""
    return STRATEGIES[strategy_used(strategy)](docs, **settings)


def chunked_by_each(docs: DataFrame, strategies: list[str], summary: Callable[[DataFrame], DataFrame] = lambda x: x, **settings) -> DataFrame:
    """(strategy, ...) of the strategies' chunks, summed up by `summary`; strategies that fall back to the same one are cut once."""
    names: dict[str, list[str]] = {}
    for strategy in strategies:
        names.setdefault(strategy_used(strategy), []).append(strategy)
    every = [summary(STRATEGIES[used](docs, **settings)).select(F.explode(F.array(*map(F.lit, asked))).alias("strategy"), "*") for used, asked in names.items()]
    return reduce(DataFrame.unionByName, every)


def collapse(text: str, longest: int = 4) -> str:
    """Adjacent repeats of a phrase of at most `longest` words collapse to one, longer phrases first."""
    words, out, i = text.split(), [], 0
    while i < len(words):
        for n in range(longest, 0, -1):
            j = i + n
            while words[j : j + n] == words[i : i + n] and j + n <= len(words):
                j += n
            if j > i + n:
                out += words[i : i + n]
                i = j
                break
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def collapsed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): (doc_id, text) with adjacent repeats collapsed; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else collapse(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string")


def same_context(a: str, b: str, threshold: float = 0.7) -> bool:
    """Of comparable length, and similar or (over 30 characters) one within the other."""
    if min(len(a), len(b)) < 0.5 * max(len(a), len(b), 1):
        return False
    short, long = sorted((a.lower(), b.lower()), key=len)
    return at_least(a, b, threshold) or (len(short) > 30 and short in long)


def prepare_contexts(contexts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """contexts (query_id, seq, content, final_score, source_file, page, title, date, url): (query_id, rank, text, final_score, citation_text).

    Texts are tidied and collapsed, blank ones dropped; of similar ones the higher score stays (then the longer text), at
    the place of the first; the rest is in order of scores. A query's contexts are its search result: one group.
    """
    tidy = strip(F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "), r"\s+([.,:;!?])", "$1"))
    cite = citation(F.col("source_file"), F.col("title"), F.col("page"), F.col("date"), F.col("url"))
    ready = contexts.select("query_id", "seq", tidy.alias("text"), F.coalesce("final_score", F.lit(0.0)).alias("final_score"), cite.alias("citation_text"))

    def prepare(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in pdf.sort_values("seq").to_dict("records"):
            row["text"] = collapse(row["text"])
            if not row["text"]:
                continue
            twin = next((i for i, other in enumerate(kept) if same_context(row["text"], other["text"], threshold)), None)
            if twin is None:
                kept.append(row)
            elif (row["final_score"], len(row["text"])) > (kept[twin]["final_score"], len(kept[twin]["text"])):
                kept[twin] = row
        kept.sort(key=lambda r: -r["final_score"])
        return pd.DataFrame([{"query_id": r["query_id"], "rank": i + 1, "text": r["text"], "final_score": r["final_score"], "citation_text": r["citation_text"]} for i, r in enumerate(kept)], columns=["query_id", "rank", "text", "final_score", "citation_text"])

    kind = contexts.schema["query_id"].dataType.simpleString()
    return ready.groupBy("query_id").applyInPandas(prepare, f"query_id {kind}, rank int, text string, final_score double, citation_text string")
