"""Scorers and model replies as columns: metrics that are plugged in, prompts, refined answers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import evaluation_form, strip, terms, words_of
from .search import PLACES, lexical_f1

# The six metrics of an answer, and the columns that each compares.
METRICS = {
    "faithfulness": ("answer", "context"),
    "answer_correctness": ("answer", "truth"),
    "context_recall": ("truth", "context"),
    "context_precision": ("context", "truth"),
    "answer_relevancy": ("answer", "question"),
    "answer_similarity": ("truth", "answer"),
}
Scorer = Callable[[Column, Column], Column]


def term_f1(a: Column, b: Column) -> Column:
    """The scorer that needs no model; null where a side is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.round(lexical_f1(terms(a), terms(b)), PLACES))


LEXICAL: dict[str, Scorer] = dict.fromkeys(METRICS, term_f1)


def metrics(items: DataFrame, scorers: dict[str, Scorer], key: str = "item_id") -> DataFrame:
    """items (key, question, context, truth, answer): (key, a column a metric, overall), overall the mean of those not null.

    scorers: a model behind each metric, a BERTScore among them; metrics without one are null.
    """
    none = F.lit(None).cast("double")
    each = items.select(key, *((scorers[m](F.col(a), F.col(b)) if m in scorers else none).alias(m) for m, (a, b) in METRICS.items()))
    given = F.filter(F.array(*METRICS), lambda x: x.isNotNull())
    mean = F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given))
    return each.withColumn("overall", F.round(mean, PLACES))


def without_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """df without a field of a struct column, or of the structs of an array column; a field that is not there is none to drop."""
    kind = df.schema[column].dataType
    inner = kind.elementType if kind.typeName() == "array" else kind
    if field not in inner.names:
        return df
    return df.withColumn(column, F.transform(column, lambda x: x.dropFields(field)) if kind.typeName() == "array" else F.col(column).dropFields(field))


def question_text(df: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """(by, questions): a group's non-blank questions one behind the other, each with its mark."""
    q = F.trim(column)
    asked = F.when(q == "", None).when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), asked.alias("q"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["q"]), "").alias("questions"))


def refined(items: DataFrame, refine: Callable[[Column], Column]) -> DataFrame:
    """items (action, answer, ...) with answers refined where the action asks for it, and whether it does (asked).

    refine(answer) is a model's reply, REFINED_ANSWER: and the text; without such a line the answer stays. Questions stay.
    """
    asked = F.col("action").isin("refine_answer", "refine_both")
    found = F.trim(F.regexp_extract(refine(F.col("answer")), r"(?m)^REFINED_ANSWER:(.*)$", 1))
    return items.withColumns({"asked": asked, "answer": F.when(asked, F.coalesce(F.nullif(found, F.lit("")), "answer")).otherwise(F.col("answer"))})


def prompt(instruction: str, contexts: Column, guideline: Column, exemplars: Column, question: Column) -> Column:
    """The sections that are there, with a rule of 80 dashes between them."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))
    section = lambda name, parts, between: F.when(F.size(parts) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(parts, between)))
    return F.concat_ws("\n" + "-" * 80 + "\n", F.lit(instruction), section("CONTEXT", numbered, "\n\n"), F.nullif(strip(guideline), F.lit("")), section("EXAMPLE", exemplars, "\n"), F.concat(F.lit("QUESTION: "), question))


def tokens(c: Column) -> Column:
    """The words of a text in the form in which answers are compared."""
    return words_of(evaluation_form(c))


# ---- semantic scores: tokens that are aligned by their vectors

#: From tokens to their vectors, a row each; called in the tasks.
TokenEmbedder = Callable[[list[str]], np.ndarray]
#: Components of the embedder that needs no model.
WIDTH = 32
#: Vectors of the other side that a token's block is compared with at once.
ALIGNED = 2048


@lru_cache(50_000)
def _token_vector(token: str) -> bytes:
    framed, out = f"#{token}#", np.zeros(WIDTH)
    for i in range(len(framed) - 2):
        out[int(hashlib.md5(framed[i : i + 3].encode()).hexdigest()[:8], 16) % WIDTH] += 1.0
    return out.tobytes()


def spelling_embedder(found: list[str]) -> np.ndarray:
    """Hashed counts of a token's three-letter parts, its edges marked: words that are spelt alike are near."""
    return np.frombuffer(b"".join(map(_token_vector, found)), np.float64).reshape(len(found), WIDTH)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def closest_cosines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a its largest cosine with a row of b, and the other way round; 0 for zero vectors and where the other has none."""
    best = np.full(len(a), -np.inf if len(b) else 0.0), np.full(len(b), -np.inf if len(a) else 0.0)
    x, y = _unit(a), _unit(b)
    for i in range(0, len(b), ALIGNED):
        for j in range(0, len(a), ALIGNED):
            of_a, of_b = slice(j, j + ALIGNED), slice(i, i + ALIGNED)
            both = x[of_a] @ y[of_b].T
            best[0][of_a] = np.maximum(best[0][of_a], both.max(axis=1))
            best[1][of_b] = np.maximum(best[1][of_b], both.max(axis=0))
    return best


def _aligned(embed: TokenEmbedder, keys: int):
    """(keys, sides): precision, recall and F1 of each row, from (side, token, n, idf) of its distinct tokens.

    A batch stays in Arrow's arrays; tokens and vectors of one row at a time become Python's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sides = [], batch.column("sides")
            side, token, n, idf = sides.values.flatten()
            side, weight = side.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False) * idf.to_numpy(zero_copy_only=False)
            offsets, given = sides.offsets.to_numpy(), sides.is_valid().to_numpy(zero_copy_only=False)
            for first, last, there in zip(offsets, offsets[1:], given):
                last = last if there else first
                found, second = token.slice(first, last - first).to_pylist(), side[first:last] == 1
                at = [np.flatnonzero(second == s) for s in (False, True)]
                if not len(at[0]) or not len(at[1]):
                    same = float(not len(at[0]) and not len(at[1]))
                    out.append((same, same, same))
                    continue
                best = closest_cosines(*(embed([found[i] for i in a]) for a in at))
                p, r = (float(w @ b / w.sum()) for w, b in zip((weight[first:last][a] for a in at), best))
                out.append((p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], *(pa.array(c, pa.float64()) for c in list(zip(*out)) or [()] * 3)], names=[*batch.schema.names[:keys], "precision", "recall", "f1"])

    return run


def alignment(pairs: DataFrame, keys: list[str], embed: TokenEmbedder = spelling_embedder) -> DataFrame:
    """pairs (keys, answer, truth): (keys, precision, recall, f1) by the tokens' alignment, a row a row; keys tell rows apart.

    Each token takes its largest cosine with a token of the other side. Precision is their mean over the answer's tokens,
    recall over the truth's, weighted by idf = ln((N + 1) / (n + 1)) + 1 over the N truths, n of which hold the token. Both sides
    empty: all are 1; one: 0. Distinct tokens are compared, with their counts as weights. Null counts as empty.
    """
    sides = pairs.select(*keys, tokens(F.coalesce("answer", F.lit(""))).alias("a"), tokens(F.coalesce("truth", F.lit(""))).alias("b"))
    of_side = lambda c, side: F.transform(c, lambda t: F.struct(F.lit(side).alias("side"), t.alias("token")))
    each = sides.select(*keys, F.explode(F.concat(of_side("a", 0), of_side("b", 1))).alias("x"))
    counted = each.groupBy(*keys, "x.side", "x.token").agg(F.count("*").alias("n"))
    held = sides.select(F.explode(F.array_distinct("b")).alias("token")).groupBy("token").agg(F.count("*").alias("held"))
    n = pairs.count()
    idf = F.log((n + 1) / (F.coalesce("held", F.lit(0)) + 1)) + 1
    weighted = counted.join(held, "token", "left").groupBy(*keys).agg(F.collect_list(F.struct("side", "token", "n", idf.alias("idf"))).alias("sides"))
    every = sides.select(*keys).join(weighted, keys, "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in every.schema if f.name in keys)
    return every.select(*keys, "sides").mapInArrow(_aligned(embed, len(keys)), f"{kinds}, precision double, recall double, f1 double")


# Phrases by which an answer says that it has no answer.
NO_INFORMATION = ("no information", "not provided", "unknown", "hindi malinaw")


def grounded(answer: Column, contexts: Column, threshold: float = 0.5) -> Column:
    """Whether a part of at least `threshold` of the answer's distinct tokens stands in one of the contexts.

    Blank answers, answers without contexts, and answers that say that they have none are not grounded.
    """
    own = F.array_distinct(tokens(answer))
    evasive = F.lit(False)
    for phrase in NO_INFORMATION:
        evasive = evasive | F.lower(answer).contains(phrase)
    in_one = F.exists(contexts, lambda c: F.size(F.array_intersect(own, tokens(c))) / F.size(own) >= threshold)
    return F.coalesce((answer != "") & (F.size(contexts) > 0) & ~evasive & (F.size(own) > 0) & in_one, F.lit(False))


def tier(score: Column) -> Column:
    return F.when(score > 0.93, "excellent").when(score > 0.90, "good").when(score > 0.70, "acceptable").otherwise("poor")


def system_metrics(items: DataFrame) -> DataFrame:
    """items (semantic, lexical, grounded, has_context, relevance): one row of counts, rates and means over all items.

    relevance is a score that items may have, null for none; instead of their list there are their number, mean and range.
    Without items the rates are 0 and the means null.
    """
    n = F.count("*")
    of = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    rate = lambda c: F.round(F.when(n > 0, of(c) / n).otherwise(0.0), PLACES)
    mean = lambda c: F.round(F.avg(c), PLACES)
    level = tier(F.col("semantic"))
    named = {f"{x}_answers": of(level == x) for x in ("excellent", "good", "acceptable", "poor")}
    rates = {f"{x}_rate": rate(level == x) for x in ("excellent", "good", "acceptable")} | {"overall_quality_rate": rate(level != "poor")}
    context = {"grounded_answers": of(F.col("grounded")), "questions_with_context": of(F.col("has_context")), "grounding_rate": rate(F.col("grounded")), "context_availability_rate": rate(F.col("has_context"))}
    means = {"avg_semantic_score": mean("semantic"), "avg_f1_score": mean("lexical"), "relevance_scores": F.count("relevance"), "avg_relevance": mean("relevance"), "min_relevance": F.min("relevance"), "max_relevance": F.max("relevance")}
    return items.agg(n.alias("total_questions"), *(c.alias(k) for k, c in (named | rates | context | means).items()))


# What stands in the place of contexts or sources that are not there.
NO_CONTEXTS, UNKNOWN_SOURCE = "No relevant documents found.", "Unknown"


def context_section(contexts: Column, detailed: bool = True) -> Column:
    """contexts (array of text, citation, source) as numbered lines, each with its citation, else its source; one sentence if there are none."""

    def line(c: Column, i: Column) -> Column:
        text = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(c["text"], F.lit("")))
        named = F.coalesce(F.nullif(c["citation"], F.lit("")), F.nullif(c["source"], F.lit("")), F.lit(UNKNOWN_SOURCE))
        return F.concat(text, F.lit(" [Source: "), named, F.lit("]")) if detailed else text

    return F.when(F.coalesce(F.size(contexts), F.lit(0)) < 1, NO_CONTEXTS).otherwise(F.array_join(F.transform(contexts, line), "\n\n"))
