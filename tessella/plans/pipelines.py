"""The three entry points as plans over batches: retrieve, answer, evaluate; and the scans of evaluation data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions.embedding import Embedder, hash_embedder
from ..functions.text import strip, terms
from ..operators import prepare
from ..operators import search as S
from ..operators.keyword_index import KeywordIndex
from ..sources.scratch import dealt, settled
from .catalog import Cases, Tables, query


def variants_of(queries: DataFrame, embed: Embedder, translations: DataFrame | None = None, decompose: Callable[[Column], Column] | None = None, most: int = 500) -> DataFrame:
    """queries (query_id, query): (query_id, list_idx, query, query_vector, weight), what is searched for each of them.

    The query itself at weight 1; its translation, if it differs, at 0.8, from a table (query, translated) that stands for a
    translator and its memory (text is cut to `most` characters, as translators do); and of long or manifold queries the
    parts that decompose(query), a model's answer, names, sharing a weight of 1.
    """
    own = queries.select("query_id", F.lit(0).alias("list_idx"), "query", F.lit(1.0).alias("weight"))
    out = own
    if translations is not None:
        memo = translations.select(F.substring("query", 1, most).alias("asked"), "translated").dropDuplicates(["asked"])
        other = queries.join(memo, F.substring("query", 1, most) == F.col("asked")).where(F.col("translated") != F.col("query"))
        out = out.unionByName(other.select("query_id", F.lit(1).alias("list_idx"), F.col("translated").alias("query"), F.lit(0.8).alias("weight")))
    if decompose is not None:
        parts = queries.where(Q.should_decompose(F.col("query"))).select("query_id", Q.sub_questions(decompose(F.col("query")), F.col("query")).alias("parts"))
        each = parts.select("query_id", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "query"))
        out = out.unionByName(each.select("query_id", (F.col("at") + 2).alias("list_idx"), "query", (1.0 / F.col("n")).alias("weight")))
    return out.withColumn("query_vector", embed(F.col("query")))


def _fused(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, index: KeywordIndex | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): semantic and keyword search, fused by weights. Without an index the texts are searched. Blank queries find nothing."""
    queries = queries.where(strip(F.col("query")) != "")
    semantic = S.nearest(vectors, queries.select("query_id", "query_vector"), k, threshold=0.2).withColumnRenamed("vec_id", "doc_id")
    asked = queries.select("query_id", "query")
    return S.hybrid(semantic, index.search(asked, k) if index else S.bm25(docs, asked, k), k)


def merged(lists: DataFrame, k: int, gate: bool = True) -> DataFrame:
    """lists (query_id, list_idx, doc_id, score, rank, weight): (query_id, doc_id, score), at most k a query.

    A query with one list keeps it. Several are fused by reciprocal rank where the gate is open, else folded by weights.
    """
    counted = lists.groupBy("query_id").agg(F.count_distinct("list_idx").alias("lists"))
    one = lists.join(counted.where("lists = 1"), "query_id").where(F.col("rank") <= k).select("query_id", "doc_id", "score")
    several = lists.join(counted.where("lists > 1"), "query_id", "left_semi")
    if gate:
        fused = S.reciprocal_rank(several.withColumn("rank", F.col("rank") - 1)).where(F.col("rank") <= k)
    else:
        fused = S.top(S.fold_merge(several), k)
    return one.unionByName(fused.select("query_id", "doc_id", "score"))


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, scorer=None, threshold: float = 0.0, variants: DataFrame | None = None, gate: bool = True, diversity: float | None = 0.5, relevance: float = 0.475, index: KeywordIndex | None = None) -> DataFrame:
    """docs (doc_id, text), vectors (vec_id, embedding), queries (query_id, query, query_vector): (query_id, doc_id, content, original_score, score, rank).

    Semantic and keyword search side by side, 2k each, fused by weights; with variants (see variants_of()) each of them is
    searched and their results are merged. The 2k best are reranked on the query itself and cut to k, from the threshold on;
    scorer(query, content) is the reranker, False leaves the fused order. Last, diversity picks among them (S.mmr with this
    bias; None: not at all) what is relevant enough. index is a keyword index of docs. Nothing found is an empty table.
    """
    if variants is None:
        found = _fused(docs, vectors, queries, 2 * k, index).drop("rank")
    else:
        named = variants.withColumn("variant", F.concat_ws(":", F.col("query_id").cast("string"), F.col("list_idx").cast("string")))
        lists = settled(_fused(docs, vectors, named.select(F.col("variant").alias("query_id"), "query", "query_vector"), 2 * k, index).withColumnRenamed("query_id", "variant"))
        found = merged(lists.join(named.select("variant", "query_id", "list_idx", "weight"), "variant"), 2 * k, gate)
    rows = S.with_rows(found, docs.select("doc_id", F.col("text").alias("content"))).join(queries.select("query_id", "query"), "query_id")
    ranked = S.rerank(dealt(rows, "query_id", "doc_id"), scorer, k, threshold).select("query_id", "doc_id", "content", "original_score", "score", "rank")
    if diversity is None:
        return ranked
    ranked = settled(ranked)
    candidates = ranked.select("query_id", F.col("rank").alias("seq"), "doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").join(queries.select("query_id", "query_vector"), "query_id")
    chosen = S.mmr(candidates, k, diversity, relevance, leave_single=True).select("query_id", "doc_id", F.col("rank").alias("place"))
    return ranked.join(chosen, ["query_id", "doc_id"]).select("query_id", "doc_id", "content", "original_score", "score", F.col("place").alias("rank"))


def extractive(query: Column, contexts: Column) -> Column:
    """The generator that needs no model: the best context's text."""
    return F.coalesce(F.try_element_at(contexts, F.lit(1)), F.lit(""))


def answer(found: DataFrame, queries: DataFrame, generate: Callable[[Column, Column], Column] = extractive) -> DataFrame:
    """found (query_id, doc_id, content, score, rank), queries (query_id, query): (query_id, kind, language, confidence, contexts, answer).

    Contexts are whole contents, cleaned, deduplicated and ordered; blank answers become a warning. A query without results is answered
    from no context.
    """
    blank = {c: F.lit(None).cast("string") for c in ("source_file", "title", "date", "url")}
    contexts = found.select("query_id", F.col("rank").cast("long").alias("seq"), "content", F.col("score").alias("final_score")).withColumns(blank | {"page": F.lit(None).cast("int")})
    ready = prepare.prepare_contexts(contexts).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    joined = queries.join(ready, "query_id", "left").withColumn("contexts", F.coalesce(F.transform("c", lambda x: x["text"]), F.array().cast("array<string>")))
    (kind, of_kind), (language, of_language) = Q.question_type(F.col("query")), Q.language(F.col("query"))
    said = strip(F.coalesce(generate(F.col("query"), F.col("contexts")), F.lit("")))
    return joined.select("query_id", kind.alias("kind"), language.alias("language"), F.round((of_kind + of_language) / 2, 6).alias("confidence"), "contexts", F.when(said == "", "[Warning: Empty response generated]").otherwise(said).alias("answer"))


def evaluate(found: DataFrame, items: DataFrame, threshold: float = 0.675, similarity=None) -> DataFrame:
    """found (query_id, content, rank), items (query_id, truth): one row of metrics over the items.

    An item's similarity is the largest of its results to its truth (term-set F1 by default); items without truth are errors.
    """
    similarity = similarity or (lambda a, b: S.lexical_f1(terms(a), terms(b)))
    pairs = found.join(items, "query_id").select("query_id", (F.col("rank") - 1).cast("long").alias("idx"), "content", F.round(similarity(F.col("content"), F.col("truth")), 6).alias("similarity"))
    best = S.best_match(pairs).select("query_id", "similarity", "idx")
    each = items.join(best, "query_id", "left").select("query_id", (strip(F.coalesce("truth", F.lit(""))) == "").alias("failed"), F.coalesce("similarity", F.lit(0.0)).alias("sim"), "idx")
    ok = lambda c: F.when(~F.col("failed"), c)
    hit = F.coalesce(F.sum(ok((F.col("sim") >= threshold).cast("long"))), F.lit(0))
    n = F.coalesce(F.sum(ok(F.lit(1))), F.lit(0))
    share = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    return each.agg(n.alias("items"), hit.alias("hits"), share(hit, n).alias("recall"), F.round(F.avg(ok(F.col("sim"))), 6).alias("mean"), F.round(F.median(ok(F.col("sim"))), 6).alias("median"), share(n, F.count("*")).alias("success_rate"))


def _batch(t: Tables) -> DataFrame:
    """Questions from the first words of all benchmark rows, each with the vector of the same number."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.substring_index("text", " ", 8).alias("query"), F.col("text").alias("truth"))
    return q.join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")


def _found(t: Tables) -> DataFrame:
    return retrieve(t.documents.select("doc_id", "text"), t.embeddings.select("vec_id", "embedding"), _batch(t).select("query_id", "query", "query_vector"), index=t.keyword_index())


@query()
def retrieve_batch(t: Tables) -> DataFrame:
    return _found(t)


@query()
def retrieve_variants(t: Tables) -> DataFrame:
    """Retrieval for all benchmark rows with a translation and the parts of each long question; texts and questions have one embedder."""
    embed = hash_embedder()
    docs = t.documents.where("doc_id is not null").select("doc_id", "text")
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    memo = queries.select("query", F.upper("query").alias("translated"))
    variants = variants_of(queries, embed, memo, lambda q: F.array_join(F.transform(F.split(q, " "), lambda w: F.concat(F.lit("What is "), w, F.lit(" there?"))), "\n"), most=2**31 - 1)
    vectors = settled(dealt(docs, "doc_id").select(F.col("doc_id").alias("vec_id"), embed(F.col("text")).alias("embedding")))
    return retrieve(docs, vectors, queries.withColumn("query_vector", embed(F.col("query"))), variants=variants, relevance=0.1, index=t.keyword_index()).drop("content")


@query()
def retrieve_plain(t: Tables) -> DataFrame:
    """Without the choice for diversity."""
    q = _batch(t).select("query_id", "query", "query_vector")
    return retrieve(t.documents.select("doc_id", "text"), t.embeddings.select("vec_id", "embedding"), q, diversity=None, index=t.keyword_index()).drop("content")


FOUND_LISTS = Cases(
    "(0, 0, 'a', 0.9, 1, 1.0), (0, 0, 'b', 0.8, 2, 1.0), (0, 1, 'b', 0.7, 1, 0.8), (0, 1, 'c', 0.6, 2, 0.8), (1, 0, 'x', 0.5, 1, 1.0), (1, 0, 'y', 0.4, 2, 1.0)",
    "query_id, list_idx, doc_id, score, rank, weight",
    "SELECT 100 + q, l, source, s, row_number() OVER (PARTITION BY q, l ORDER BY s DESC, source), 1.0 FROM (SELECT doc_id % 40 AS q, CASE WHEN doc_id % 40 < 9 THEN 0 ELSE n_chars % 2 END AS l, source, max(n_chars) / 16384.0 AS s FROM documents GROUP BY 1, 2, 3)",
)


@query(f"""WITH l AS (SELECT * FROM {FOUND_LISTS}), n AS (SELECT query_id, count(DISTINCT list_idx) AS lists FROM l GROUP BY query_id)
  SELECT query_id, doc_id, round(CASE WHEN max(lists) = 1 THEN max(score) ELSE sum(1.0 / (60 + rank)) END, 6)::DOUBLE AS score FROM l JOIN n USING (query_id) GROUP BY ALL""")
def fusion_gate(t: Tables) -> DataFrame:
    lists = t.cases(FOUND_LISTS).withColumns({c: F.col(c).cast("double") for c in ("score", "weight")})
    return merged(lists, 10_000)


@query()
def answer_batch(t: Tables) -> DataFrame:
    return answer(_found(t), _batch(t).select("query_id", "query"))


@query()
def evaluate_batch(t: Tables) -> DataFrame:
    return evaluate(_found(t), _batch(t).select("query_id", "truth"), 0.1)


@query()
def evaluate_default_threshold(t: Tables) -> DataFrame:
    return evaluate(_found(t), _batch(t).select("query_id", "truth"))


def items_of(rows: DataFrame, order: str, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """A dataset's rows, or the first of them: in the order of a column, or shuffled by a seed, which gives the same rows each time."""
    if limit is None:
        return rows
    places = [F.xxhash64(F.lit(seed), order), order] if seed is not None else [order]
    return rows.orderBy(*places).limit(limit)


@query("SELECT doc_id, text AS question, coalesce(l.quality, 0) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def evaluation_items(t: Tables) -> DataFrame:
    """The whole dataset."""
    rows = items_of(t.documents.select("doc_id", F.col("text").alias("question")), "doc_id")
    return rows.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "question", F.coalesce("quality", F.lit(0)).alias("label"))


INPUTS = Cases(
    "(1, 'q1', 'g1', 'a1', 'm1', 'gold'), (2, 'q2', 'g2', '', 'm2', ''), (3, '', 'g3', 'a3', '', 'gold'), (4, 'q4', NULL, 'a4', '', 'gold'), (5, 'q5', 'g5', NULL, 'm5', NULL)",
    "id, question, truth, answer, model_answer, gold",
    "SELECT 1000 + conv_id * 1000 + turn, CASE WHEN turn % 5 = 4 THEN '' ELSE split_part(text, '.', 1) END, CASE WHEN turn % 7 = 3 THEN NULL ELSE text END, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN '' END, CASE WHEN conv_id % 2 = 0 THEN 'model ' || role ELSE '' END, CASE WHEN turn % 2 = 0 THEN role WHEN turn % 3 = 0 THEN '' END FROM conversations",
)


@query(f"SELECT id, question, truth, coalesce(nullif(answer, ''), model_answer) AS answer FROM {INPUTS} WHERE question <> '' AND truth <> '' AND coalesce(nullif(answer, ''), model_answer) <> ''")
def answer_inputs(t: Tables) -> DataFrame:
    """An empty answer counts as missing; rows without a required field are skipped."""
    answered = F.coalesce(F.nullif("answer", F.lit("")), "model_answer")
    return t.cases(INPUTS).select("id", "question", "truth", answered.alias("answer")).where("question <> '' and truth <> '' and answer <> ''")


@query(f"SELECT id, question, gold FROM {INPUTS} WHERE question <> '' AND gold <> ''")
def judge_inputs(t: Tables) -> DataFrame:
    """The gold answer is read from the metadata alone."""
    return t.cases(INPUTS).where("question <> '' and gold <> ''").select("id", "question", "gold")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, count(*) OVER (PARTITION BY source) AS turns FROM documents WHERE n_chars / 10000.0 >= 0.2")
def post_filter(t: Tables) -> DataFrame:
    """The threshold that applies to finished results, with what is left numbered anew."""
    w = Window.partitionBy("source")
    return t.documents.where("n_chars / 10000.0 >= 0.2").select("source", "doc_id", F.row_number().over(w.orderBy("doc_id")).cast("long").alias("turn"), F.count("*").over(w).alias("turns"))
