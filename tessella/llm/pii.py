"""Operator 3, sanitisation of personal data by information theory.

Protected entities are e-mail addresses, IP addresses, card and phone numbers and secrets (long keys of letters and digits),
found by their formats. Around each stands a context of CONTEXT words on either side. Over the whole corpus it is counted how
often a term occurs at all, and how often in the contexts of each kind of entity, and of each single entity. With p(e) the
part of all words that are context of e (a kind, or one entity),

    IC(e) = -log2 p(e)                 what it takes to know that e is near
    PMI(t; e) = log2 p(e | t) / p(e)   what the term t tells of it
    disclosure(t, e) = PMI(t; e) / IC(e)   1 if t gives e away, 0 if it says nothing

A term whose disclosure is at or above GENERALISE is replaced by its kind's name, at or above REMOVE it is removed, wherever
it stands in the corpus, near an entity or not: who reads it would know of the entity. The entity itself is always replaced.

A term counts for e only with LEAST different contexts of e that it occurs in (copies of a passage are one context): so a
handful of chance neighbours discloses nothing, and a passage that is copied much does not disclose by its copies. Nothing
else bounds the number of terms, so they stay a table, which texts are joined with by their terms; while the table has at
most KNOWN terms, their hashes go to the tasks, so that terms which are none need not be sent to the join.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table
from .memo import Memo

KINDS = ("email", "ip", "card", "phone")
PROTECTED = (*KINDS, "secret")
#: Words on either side of an entity that are its context.
CONTEXT = 5
GENERALISE, REMOVE = 0.8, 0.95
#: Different contexts of an entity that a term must occur in.
LEAST = 5
#: Terms whose hashes are sent to all tasks at most: 8 bytes each.
KNOWN = 100_000
#: Distinct terms a task counts before it sends what it has.
TERMS = 200_000

_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_ip = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_term = re.compile(r"[^\W\d_]+")
_key = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}")
_not_digit = re.compile(r"[^0-9]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """The run of local characters before each @, and the domain behind it: linear, however long the run."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Entities by their formats: leftmost, not overlapping within a kind, kinds as listed; failing matches are dropped."""
    out = list(_emails(text)) if "@" in text else []
    if not _digit.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _not_digit.sub("", m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 9 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


def outside_words(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Where the words of the whole text stand that touch none of the spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):  # joined where they overlap
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start), ends.append(end)
    out = []
    for m in _term.finditer(text):
        i = bisect_left(starts, m.end()) - 1
        if i < 0 or ends[i] <= m.start():
            out.append(m.span())
    return out


def secrets(text: str) -> list[Span]:
    """Keys: at least 32 letters and digits in a row, of both at least four."""
    return [("secret", m.start(), m.end()) for m in _key.finditer(text) if 4 <= len(_not_digit.sub("", m[0])) <= m.end() - m.start() - 4]


def protected_spans(text: str) -> list[Span]:
    """base_spans(), then secrets: what is protected, by kind and place."""
    return base_spans(text) + secrets(text) if _digit.search(text) else base_spans(text)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def contexts(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(kind, hash of the entity, hash of its context, the context's words) for each span.

    Whole words, and none that touch any span; the context's hash is that of the text on either side, without the entity.
    """
    words = [m.span() for m in _term.finditer(text)] if spans else []
    begins, finishes, outside = [a for a, _ in words], [b for _, b in words], set(outside_words(text, spans)) if spans else set()
    for kind, start, end in spans:
        value = text[start:end].lower() if kind in ("email", "ip", "secret") else _not_digit.sub("", text[start:end])
        i, j = bisect_right(finishes, start), bisect_left(begins, end)
        left, right = words[max(0, i - CONTEXT) : i], words[j : j + CONTEXT]
        around = f"{text[left[0][0] : start] if left else ''}\0{text[end : right[-1][1]] if right else ''}"
        yield kind, _hash(f"{kind}:{value}") or 1, _hash(around), [w for w in left + right if w in outside]


COUNTS = pa.schema([("kind", pa.string()), ("entity", pa.int64()), ("term", pa.string()), ("context", pa.int64()), ("n", pa.int64())])
COUNTS_DDL = "kind string, entity long, term string, context long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, entity, term, context, n): occurrences of terms at all (kind ""), in contexts of a kind (entity 0) and of an entity.

    The same for all terms together (term null); summed in the task first.
    """
    words: Counter = Counter()
    near: Counter = Counter()

    def send() -> pa.RecordBatch:
        rows = [("", 0, t, 0, n) for t, n in words.items()] + [("", 0, None, 0, words.total())]
        rows += [(*key, n) for key, n in near.items()]
        words.clear(), near.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)), COUNTS)], schema=COUNTS)

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            words.update(map(str.casefold, _term.findall(text)))
            counted = set()
            for kind, entity, context, around in contexts(text, protected_spans(text)):
                terms = [text[a:b].casefold() for a, b in around]
                for e in (0, entity):
                    for (a, _), term in zip(around, terms):
                        if (kind, e, a) not in counted:  # a word is context of a kind or an entity once
                            counted.add((kind, e, a))
                            near[kind, e, term, context] += 1
                            near[kind, e, None, 0] += 1
            if len(words) + len(near) > TERMS:
                yield send()
    yield send()


def disclosure(docs: DataFrame) -> DataFrame:
    """docs (text): (kind, entity, term, n, support, disclosure) from the co-occurrence in the whole corpus; entity 0: the kind."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, COUNTS_DDL)
    counts = stash(rows.groupBy("kind", "entity", "term").agg(F.sum("n").alias("n"), F.count_distinct("context").alias("support")))
    totals = counts.where("term is null").select("kind", "entity", F.col("n").alias("of_entity"))
    words = totals.where("kind = ''").agg(F.sum("of_entity")).first()[0] or 0
    of_kind = {r["kind"]: r["of_entity"] for r in totals.where("entity = 0 and kind <> ''").collect()}  # one row a kind
    near = counts.where(f"term is not null and kind <> '' and support >= {LEAST}")
    whole = near.where("entity = 0").withColumn("of_entity", sum((F.when(F.col("kind") == k, n).otherwise(0) for k, n in of_kind.items()), F.lit(0)).cast("long"))
    single = near.where("entity <> 0").join(totals.where("entity <> 0"), ["kind", "entity"]).select(*whole.columns)
    each = whole.unionAll(single).join(counts.where("kind = '' and term is not null").select("term", F.col("n").alias("of_term")), "term")
    p, given = F.col("of_entity") / F.lit(float(max(words, 1))), F.least(F.col("n") / F.col("of_term"), F.lit(1.0))
    return each.where(p < 1).select("kind", "entity", "term", "n", "support", (F.log2(given / p) / -F.log2(p)).alias("disclosure"))


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(term, kind, remove): the terms at or above GENERALISE, with the kind that each discloses most, and whether it is removed."""
    found = disclosure(docs).where(F.col("disclosure") >= GENERALISE)
    most = F.max(F.struct("disclosure", F.array_position(F.array(*map(F.lit, PROTECTED[::-1])), F.col("kind")).alias("first"), "kind"))
    return found.groupBy("term").agg(most.alias("m")).select("term", F.col("m.kind").alias("kind"), (F.col("m.disclosure") >= REMOVE).alias("remove"))


def _sought(known):
    """(digest, term): the distinct terms of a text that could be disclosing. known: the hashes of all that are, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_one = Memo((lambda t: _hash(t) in held) if (held := known and frozenset(known.value)) else (lambda t: True), 100_000)
        for batch in batches:
            rows = []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    rows += [(digest, t) for t in set(map(str.casefold, _term.findall(text))) if is_one[t]]
                    is_one.trim()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [()] * 2], names=["digest", "term"])

    return run


def with_terms(docs: DataFrame) -> DataFrame:
    """docs (text, ...) and __terms, the disclosing (term, kind, remove) that a row's text holds; null for none."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    terms = stash(disclosing_terms(docs))
    few = [_hash(r["term"]) for r in terms.select("term").limit(KNOWN + 1).collect()]
    if not few:
        return docs.withColumn("__terms", F.lit(None).cast("array<struct<term:string,kind:string,remove:boolean>>"))
    known = spark.sparkContext.broadcast(few) if len(few) <= KNOWN else None
    held = docs.select(F.md5(text.cast("binary")).alias("digest"), text.alias("text")).mapInArrow(_sought(known), "digest string, term string")
    held = held.join(terms, "term").groupBy(F.col("digest").alias("__digest")).agg(F.collect_set(F.struct("term", "kind", "remove")).alias("__terms"))
    # written out, so that its size is known: while it is small, no text is shuffled
    return docs.withColumn("__digest", F.md5(text.cast("binary"))).join(stash(held), "__digest", "left").drop("__digest")


Terms = dict[str, tuple[str, bool]]


def _terms_of(batch: pa.RecordBatch) -> list[Terms]:
    return [{t["term"]: (t["kind"], t["remove"]) for t in row or ()} for row in batch.column("__terms").to_pylist()]


def find(text: str, terms: Terms) -> tuple[list[Span], list[tuple[str, bool, int, int]]]:
    """(protected spans, (kind, remove, start, end) of disclosing terms in the whole text), both in order."""
    spans = protected_spans(text)
    if not terms:
        return spans, []
    return spans, [(*terms[t], a, b) for a, b in outside_words(text, spans) if (t := text[a:b].casefold()) in terms]


def sanitise(text: str, spans: list[Span], hits: list[tuple[str, bool, int, int]]) -> str:
    """Entities and generalised terms become their kind's name in brackets; removed terms go. Of overlapping spans the first counts."""
    every = sorted([(s, -e, f"[{k.upper()}]") for k, s, e in spans] + [(s, -e, "" if remove else f"[{k.upper()}-TERM]") for k, remove, s, e in hits])
    out, at = [], 0
    for start, end, name in every:
        if start >= at:
            out += [text[at:start], name]
            at = -end
    return "".join([*out, text[at:]])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


N_KINDS = tuple(f"n_{k}" for k in KINDS)
FOUND_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_term long, n_spans long"


def _find(keep_text: bool):
    kinds = {"doc_id": pa.int64()} | dict.fromkeys(N_KINDS, pa.int64()) | {"base_sha256": pa.string(), "spans": pa.string(), "n_secret": pa.int64(), "n_term": pa.int64(), "n_spans": pa.int64()} | ({"sanitised": pa.string()} if keep_text else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, terms in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), _terms_of(batch)):
                spans, hits = find(text or "", terms)
                base = _listed([s for s in spans if s[0] in KINDS])
                n = Counter(k for k, _, _ in spans)
                row = (doc_id, *(n[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), _listed(spans + [("term", s, e) for _, _, s, e in hits]), n["secret"], len(hits), len(spans) + len(hits))
                out.append((*row, sanitise(text, spans, hits) if text else text) if keep_text else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds.values())], names=list(kinds))

    return run


def personal_data(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans [, sanitised]),
    a row a row.

    spans: kind:start:end of the base spans in order of kind and place, then of the secrets, then of the disclosing terms
    (term:start:end). Null and empty texts have none. Rows that repeat a doc_id, or have none, are searched each for itself;
    repeated rows count as often as they occur in the corpus counts, but as one context. Other columns, whatever their names,
    are not read. A corpus without entities, and an empty table, disclose nothing.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_terms(given).mapInArrow(_find(keep_text), FOUND_DDL + ", sanitised string" * keep_text)


def sanitised_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, and n_chars to match where there is such a column; other columns as they are.

    A row a row, in any order; null and empty texts stay, repeated rows are sanitised each for itself, an empty table gives an
    empty one. Columns of docs may have any names but __digest and __terms.
    """
    names, types = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [sanitise(t, *find(t, terms)) if t else t for t, terms in zip(batch.column("text").to_pylist(), _terms_of(batch))]
            batch = batch.select(names)
            i = names.index("text")
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            yield batch

    out = with_terms(docs).mapInArrow(run, types)
    return out.withColumn("n_chars", F.length("text").cast(types["n_chars"].dataType)) if "n_chars" in names else out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
