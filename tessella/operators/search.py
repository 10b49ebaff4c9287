"""Keyword and vector search over batches of queries, and what joins their results.

Queries come as a table, one query is a batch of one. Scores are rounded to PLACES before they rank, and ids break ties, so
that results do not depend on the order in which sums were taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import terms
from ..sources.scratch import settled

PLACES = 6
#: Queries and vectors that are compared as one product of matrices.
QUERY_BLOCK, VECTOR_BLOCK = 500, 1000
#: Queries that a task holds the best of before it tells them.
HELD = 20_000


def term_statistics(docs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """docs (doc_id, text): (term, n), in how many documents each term occurs, and in a row without term (documents, their terms).

    by names columns that say which collection a document is in. One scan; a document's distinct terms are found in place and
    counts are combined before the shuffle, which moves a row a term and task. Kept, as every search reads it several times.
    """
    split = docs.select(*by, terms(F.col("text")).alias("terms"))
    none = F.array(F.lit(None).cast("string"))
    each = split.select(*by, F.size("terms").alias("dl"), F.explode(F.concat(F.array_distinct("terms"), none)).alias("term"))
    return settled(each.groupBy(*by, "term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("length")))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, within: bool = False) -> DataFrame:
    """docs (doc_id, text), queries (query_id, query): (query_id, doc_id, score, rank) of the k best with a score >= 0.

    A term's weight is ln(N - n + 0.5) - ln(n + 0.5); negative ones become epsilon times the mean over all terms. A term
    that a query repeats counts as often. Documents that hold no term of the query score 0 and come last, by id, as needed
    to fill k. within: docs has a query_id, too, and each query searches its own documents as a collection of its own.

    Only occurrences of terms that are asked for leave the scan of the texts.
    """
    by = ["query_id"] if within else []
    stats = term_statistics(docs, by)
    of_all = stats.where("term is null").select(*by, F.col("n").alias("docs"), (F.col("length") / F.col("n")).alias("avgdl"))
    counted = stats.where("term is not null").select(*by, "term", "n")
    if within:
        weights, totals = counted.join(of_all, by), of_all
    else:
        total = of_all.first()  # one row, so two numbers of the plan
        n, avgdl = (total["docs"], total["avgdl"]) if total else (0, 0.0)
        weights = counted.withColumns({"docs": F.lit(n), "avgdl": F.lit(avgdl)})
    weights = weights.withColumn("raw", F.log(F.col("docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    if within:
        mean = weights.groupBy(*by).agg(F.avg("raw").alias("mean"))
        wanted = asked.join(weights, [*by, "term"]).join(mean, by)
    else:
        wanted = asked.join(weights, "term").withColumn("mean", F.lit(weights.agg(F.avg("raw")).first()[0]))
    wanted = wanted.select("query_id", "term", "times", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    split = docs.select(*by, "doc_id", terms(F.col("text")).alias("terms"))
    held = split.select(*by, "doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(wanted.select(*by, "term").distinct(), [*by, "term"], "left_semi")
    hits = held.groupBy(*by, "doc_id", "dl", "term").agg(F.count("*").alias("tf")).join(wanted, [*by, "term"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    if within:
        first = docs.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(F.col("at") <= k).select("query_id", "doc_id")
        filler = queries.select("query_id").join(first, "query_id")
    else:
        filler = queries.select("query_id").crossJoin(F.broadcast(docs.select("doc_id").orderBy("doc_id").limit(k)))  # k rows: enough to fill up any query
    every = hits.select("query_id", "doc_id", part.alias("part")).unionByName(filler.select("query_id", "doc_id", F.lit(0.0).alias("part")))
    return top(every.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), PLACES).alias("score")).where("score >= 0"), k)


def top(scored: DataFrame, k: int, by: str = "query_id", of: str = "doc_id") -> DataFrame:
    """The k best of each query, with their rank from 1; planned as a group limit before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), of)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    """In double precision, component after component."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is empty or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def score_of(metric: str, a: Column, b: Column) -> Column:
    """l2sq: exp(-squared distance), as vector stores do by default; cosine; ip: inner product."""
    return {"l2sq": lambda: F.exp(-squared_distance(a, b)), "cosine": lambda: cosine(a, b), "ip": lambda: dot(a, b)}[metric]()


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """score_of() of all pairs of rows, in double precision."""
    if metric == "l2sq":
        return np.exp(-((x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (x @ q.T)).clip(0))
    both = x @ q.T
    if metric == "ip":
        return both
    norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None, :]
    return np.divide(both, norm, out=np.zeros_like(both), where=norm > 0)


def _blocks(id_name: str, vector_name: str, rows: int):
    """Rows gathered into blocks: (ids, vectors), the vectors' components behind each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(vector_name).is_valid())
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(id_name).to_pylist()]), pa.array([part.column(vector_name).to_pylist()], pa.list_(pa.list_(pa.float64())))], names=["ids", "vectors"])

    return run


def _best_of_blocks(metric: str, k: int, kinds: list[pa.DataType]):
    """Pairs of blocks: the k best of each query that the task has seen, told when it holds HELD queries and when it ends."""

    def tell(best: dict) -> pa.RecordBatch:
        rows = [(q, i, float(score)) for q, held in best.items() for _, i, score in held]
        best.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    def matrix(vectors: pa.ListScalar) -> np.ndarray:
        rows = vectors.values
        if len(rows.value_lengths().unique()) > 1:
            raise ValueError("vectors of different widths")
        return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for ids, vectors, asked, query_vectors in zip(*(batch.column(c) for c in ("ids", "vectors", "asked", "query_vectors"))):  # a pair of blocks at a time leaves Arrow
                ids, asked = ids.values.to_pylist(), asked.values.to_pylist()
                order = sorted(range(len(ids)), key=ids.__getitem__)  # ties go to the smaller id
                scores = _scores(metric, matrix(vectors)[order], matrix(query_vectors))
                rounded = np.round(scores, PLACES)
                bars = np.array([-best[q][-1][0] if len(best.get(q, ())) == k else -np.inf for q in asked])
                for j in np.flatnonzero(~(rounded.max(axis=0) < bars)):  # the others have k better ones
                    query, near = asked[j], np.flatnonzero(~(rounded[:, j] < bars[j]))
                    most = near[np.argsort(-rounded[near, j], kind="stable")[:k]]
                    held = best.get(query, []) + [(-rounded[m, j], ids[order[m]], scores[m, j]) for m in most]
                    best[query] = sorted(held, key=lambda x: x[:2])[:k]
                if len(best) > HELD:
                    yield tell(best)
        yield tell(best)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2sq", threshold: float | None = 0.2, most: int = 20) -> DataFrame:
    """vectors (vec_id, embedding), queries (query_id, query_vector): (query_id, vec_id, score, rank).

    Brute force in blocks: blocks of queries meet blocks of vectors as a product of matrices, each task keeps its k best of
    every query, and only those are shuffled. Whether the queries' blocks are sent to all tasks is left to Catalyst, which
    knows their size. The threshold applies after the cut to min(k, most). Null vectors and empty ones, as embedders give of blank
    texts, are left out on both sides.
    """
    k = min(k, most)
    v = vectors.where(F.size("embedding") > 0).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = queries.where(F.size("query_vector") > 0).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    kinds = {f.name: f.dataType for f in [*v.schema, *q.schema]}
    blocks = v.mapInArrow(_blocks("vec_id", "embedding", VECTOR_BLOCK), f"ids array<{kinds['vec_id'].simpleString()}>, vectors array<array<double>>")
    asked = q.mapInArrow(_blocks("query_id", "query_vector", QUERY_BLOCK), f"ids array<{kinds['query_id'].simpleString()}>, vectors array<array<double>>")
    pairs = blocks.crossJoin(asked.select(F.col("ids").alias("asked"), F.col("vectors").alias("query_vectors")))
    schema = [to_arrow_type(kinds["query_id"]), to_arrow_type(kinds["vec_id"]), pa.float64()]
    found = pairs.mapInArrow(_best_of_blocks(metric, k, schema), f"query_id {kinds['query_id'].simpleString()}, vec_id {kinds['vec_id'].simpleString()}, score double")
    best = top(found.withColumn("score", F.round("score", PLACES)), k, of="vec_id")
    return best if threshold is None else best.where(F.col("score") >= threshold)


def minmax(scored: DataFrame, by: list[str]) -> DataFrame:
    """Scores of each list to 0..1; all equal become 1."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def hybrid(semantic: DataFrame, keyword: DataFrame, k: int = 5, semantic_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Both (query_id, doc_id, score, rank): min-max, then the weighted sum, a missing side counting 0.

    Ties keep the semantic order, then the keyword order. Weights are normalised; both 0.5 if they sum to nothing.
    """
    total = semantic_weight + keyword_weight
    ws, wk = (semantic_weight / total, keyword_weight / total) if total > 0 else (0.5, 0.5)
    s = minmax(semantic, ["query_id"]).select("query_id", "doc_id", F.col("score").alias("s"), F.col("rank").alias("s_rank"))
    t = minmax(keyword, ["query_id"]).select("query_id", "doc_id", F.col("score").alias("t"), F.col("rank").alias("t_rank"))
    joined = s.join(t, ["query_id", "doc_id"], "full_outer")
    scored = joined.withColumn("score", F.round(ws * F.coalesce("s", F.lit(0.0)) + wk * F.coalesce("t", F.lit(0.0)), PLACES))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("s_rank"), F.asc_nulls_last("t_rank"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def reciprocal_rank(lists: DataFrame, constant: int = 60, weighted: bool = False) -> DataFrame:
    """lists (query_id, list_idx, rank from 0, doc_id [, weight]): (query_id, doc_id, score, appearances, first_seen, rank).

    Sum of 1 / (constant + rank + 1); of equal scores more appearances, then the earlier first sight.
    """
    gain = (F.col("weight") if weighted else F.lit(1.0)) / (constant + F.col("rank") + 1)
    seen = F.min(F.struct("list_idx", F.col("rank").alias("at"))).alias("seen")
    fused = lists.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "").groupBy("query_id", "doc_id").agg(F.round(F.sum(gain), PLACES).alias("score"), F.count("*").alias("appearances"), seen)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("appearances"), "seen.list_idx", "seen.at")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "appearances", "rank")


def fusion_key(content: Column, metadata: Column) -> Column:
    """What tells the documents of fused lists apart: their content, of blank ones the metadata."""
    return F.coalesce(F.nullif(content, F.lit("")), metadata)


def weighted_fusion(lists: DataFrame, weights: DataFrame, missing: float = 0.5) -> DataFrame:
    """lists (query_id, list_idx, doc_id, score), weights (list_idx, weight): (query_id, doc_id, score).

    Weights are normalised over all lists; a list that does not hold a document counts the missing score for it.
    """
    share = weights.withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
    found = lists.join(F.broadcast(share.select("list_idx", "w")), "list_idx").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.coalesce("score", F.lit(missing))).alias("given"), F.sum("w").alias("held"))
    return found.select("query_id", "doc_id", F.round(F.col("given") + (1 - F.col("held")) * missing, PLACES).alias("score"))


def fold_merge(lists: DataFrame) -> DataFrame:
    """lists (query_id, list_idx, doc_id, score, weight): first score * weight, then (so far + score * weight) / 2, list by list."""
    rows = F.array_sort(F.collect_list(F.struct("list_idx", (F.col("score") * F.col("weight")).alias("x"))))
    merged = lists.groupBy("query_id", "doc_id").agg(rows.alias("rows"))
    scores = F.transform("rows", lambda r: r["x"])
    return merged.select("query_id", "doc_id", F.round(F.aggregate(F.slice(scores, 2, 1 << 30), F.element_at(scores, 1), lambda a, x: (a + x) / 2), PLACES).alias("score"))


def with_rows(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found (..., doc_id) with its documents' columns. What was found is written first: so it is found once, and Catalyst knows its
    size and sends it to the documents, not all texts to it."""
    return settled(found).join(docs, "doc_id")


def lexical_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets: 1 if both are empty, 0 if one is."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def rerank(results: DataFrame, scorer=None, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """results (query_id, query, doc_id, content, score): the k best by scorer(query, content) from the threshold on.

    The default scorer compares the term sets; scorer=False (no model) falls back to the given scores, without a threshold.
    """
    if scorer is False:
        return top(results.withColumn("original_score", F.col("score")), k)
    scorer = scorer or (lambda q, c: lexical_f1(terms(q), terms(c)))
    scored = results.withColumn("original_score", F.col("score")).withColumn("score", F.round(scorer(F.col("query"), F.col("content")), PLACES))
    return top(scored.where(F.col("score") >= threshold), k)


def mmr(candidates: DataFrame, k: int = 5, bias: float = 0.5, threshold: float = 0.475, leave_single: bool = False) -> DataFrame:
    """candidates (query_id, seq, doc_id, embedding, query_vector): (query_id, doc_id, score, rank), diverse and relevant.

    Candidates below the threshold go; the most relevant comes first, then each time the largest bias * relevance -
    (1 - bias) * (largest cosine with a chosen one); ties go to the earlier candidate. A query without a vector keeps its
    first k (score null); leave_single keeps a result that is the only one as it is. Candidates without a vector are
    relevant to nothing. A query's candidates are a search result (bounded by its k), so a query is one task's group.
    """

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        vector = pdf["query_vector"].iloc[0]
        if vector is None or not len(vector) or (leave_single and len(pdf) < 2):
            chosen, scores = list(range(min(k, len(pdf)))), [None] * min(k, len(pdf))
        else:
            q = np.array(vector, np.float64)
            x = np.array([np.zeros(len(q)) if e is None or not len(e) else e for e in pdf["embedding"]], np.float64)
            norm = np.linalg.norm(x, axis=1)
            unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
            relevance = unit @ (q / (np.linalg.norm(q) or 1.0))
            left, chosen = [i for i in range(len(x)) if relevance[i] >= threshold], []
            while left and len(chosen) < k:
                gain = [relevance[i] if not chosen else bias * relevance[i] - (1 - bias) * (unit[chosen] @ unit[i]).max() for i in left]
                chosen.append(left.pop(int(np.argmax(np.round(gain, 9)))))
            scores = np.round(relevance[chosen], PLACES).tolist()
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": pdf["doc_id"].iloc[chosen].to_numpy(), "score": pd.Series(scores, dtype="float64").to_numpy(), "rank": range(1, len(chosen) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy("query_id").applyInPandas(select, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, rank int")


def best_match(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, idx, content, similarity): the largest similarity above 0, the first of equals; (0, "", -1) if none."""
    best = pairs.groupBy("query_id").agg(F.max(F.when(F.col("similarity") > 0, F.struct("similarity", (-F.col("idx")).alias("before"), "content"))).alias("b"))
    return best.select("query_id", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"), F.coalesce("b.content", F.lit("")).alias("content"), F.coalesce(-F.col("b.before"), F.lit(-1)).alias("idx"))
