"""Queries over sources, sinks and what is plugged in: files written from the tables and read again, stores, reports, scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import hash_embedder
from ..functions.text import strip, strip_sql, terms
from ..operators import prepare, scores, trees
from ..operators import search as S
from ..sources import readers as R
from ..sources.scratch import working_folder
from ..sources.vector_store import EmbeddingCache, VectorStore
from .catalog import Tables, query
from .search_queries import ASKED, BM25, EMBED, f1_sql, questions_asked
from .text_queries import TERMS


@query("""SELECT 'item_id=' || item_id AS parent, '.txt' AS extension, 'text' AS loader, 'unknown' AS kind, octet_length(encode(text)) + 1 AS size, sha256(text || chr(10)) AS hash, text || chr(10) AS text FROM benchmark""")
def directory_scan(t: Tables) -> DataFrame:
    """A folder with a text file for each benchmark row, listed and read."""
    folder = working_folder(t.spark)
    t.benchmark.repartition("item_id").write.partitionBy("item_id").text(folder)
    files = R.scan(t.spark, folder)
    read = R.read_documents(files).select("path", "text")
    return files.join(read, "path").select("parent", "extension", "loader", "kind", "size", "hash", "text")


def _lists(t: Tables) -> DataFrame:
    """A JSON file for each conversation, a list of records; every seventh is cut off."""
    path = F.format_string("file:/a/b/c/data/knowledge_base/wikipedia/talk%d/%d.json", F.col("conv_id") % 3, F.col("conv_id"))
    turn = F.struct("turn", F.col("role").alias("title"), "text")
    content = F.to_json(F.transform(F.array_sort(F.collect_list(turn)), lambda r: F.struct(r["title"].alias("title"), r["text"].alias("text"))))
    whole = t.conversations.groupBy("conv_id").agg(content.alias("c"))
    c = F.when(F.col("conv_id") % 7 == 3, F.substr("c", F.lit(1), F.length("c") - 2)).otherwise(F.col("c"))
    return R.described(whole.select("conv_id", path.alias("path"), c.cast("binary").alias("content")))


@query("""SELECT 'b.c.data.knowledge_base.wikipedia.talk' || (conv_id % 3) AS subfolder_path, 'wikipedia' AS kind, role AS title, text, 'ok' AS status FROM conversations WHERE conv_id % 7 <> 3
  UNION ALL SELECT 'b.c.data.knowledge_base.wikipedia.talk' || (conv_id % 3), 'wikipedia', NULL, '', 'error' FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 3)""")
def json_corpus(t: Tables) -> DataFrame:
    return R.read_documents(_lists(t)).select("subfolder_path", "kind", "title", "text", "status")


@query("SELECT trim(role) AS question, trim(text) AS ground_truth FROM conversations WHERE conv_id % 7 <> 3")
def reshape_folder(t: Tables) -> DataFrame:
    """The entries of all files of a folder; files that do not parse are skipped."""
    rows = R.read_documents(_lists(t)).where("status = 'ok'")
    return rows.select(F.trim("title").alias("question"), F.trim("text").alias("ground_truth"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents"


@query(f"""WITH l AS ({_LINES}), p AS (SELECT doc_id, page, CASE WHEN length({strip_sql('line')}) < 50 THEN line || ' (blocks)' ELSE line END AS text FROM l), k AS (SELECT * FROM p WHERE {strip_sql('text')} <> ''),
  good AS (SELECT doc_id FROM k GROUP BY doc_id HAVING max(length({strip_sql('text')})) > 50),
  r AS (SELECT doc_id, page, text, 'ok' AS status FROM k WHERE doc_id IN (SELECT doc_id FROM good) UNION ALL SELECT doc_id, 1, 'fallback ' || lang, 'ok' FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM good))
  SELECT doc_id || '.pdf' AS path, page::INT AS page, text, status FROM r UNION ALL SELECT doc_id || '.pdf', NULL, NULL, 'error' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)""")
def pdf_page_choice(t: Tables) -> DataFrame:
    """Lines stand for pages of a first reader, the language for the text of a second one that can read half of the files."""
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path")
    files = t.documents.select(path)
    lines = t.documents.select(path, F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    primary = lines.select("path", (F.col("at") + 1).alias("page"), "text", F.concat("text", F.lit(" (blocks)")).alias("blocks"))
    fallback = t.documents.where("doc_id % 2 = 0").select(path, F.lit(1).alias("page"), F.concat(F.lit("fallback "), "lang").alias("text"))
    return R.choose_pages(files, primary, fallback)


@query(f"""SELECT CASE doc_id % 4 WHEN 0 THEN doc_id || '.pdf' WHEN 1 THEN doc_id || '.txt' WHEN 2 THEN doc_id || '.docx' ELSE doc_id || '.rtf' END AS path,
  CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10)) WHEN 1 THEN text WHEN 2 THEN upper(lang) END AS text, CASE WHEN doc_id % 4 = 3 THEN 'error' ELSE 'ok' END AS status FROM documents""")
def question_sources(t: Tables) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".txt", ".docx", ".rtf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = t.documents.select("lang", "text", F.concat(F.col("doc_id").cast("string"), suffix).alias("path"))
    pages = docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))
    return R.whole_texts(R.described(docs.select("path", F.col("text").cast("binary").alias("content"))), pages, docs.select("path", F.upper("lang").alias("text")))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Title ' || page_id ELSE 'News Article' END AS title FROM pages")
def remote_titles(t: Tables) -> DataFrame:
    """What a fetcher found for every third page, and the constant for the rest."""
    fetched = t.pages.where("page_id % 3 = 0").select("page_id", F.concat(F.lit(" Title "), F.col("page_id").cast("string")).alias("fetched"))
    return t.pages.select("page_id").join(fetched, "page_id", "left").select("page_id", R.remote_title(F.col("fetched")).alias("title"))


@query("""WITH b AS (SELECT conv_id, list(text ORDER BY turn) AS docs FROM conversations GROUP BY conv_id), e AS (SELECT conv_id, unnest(docs) AS document, generate_subscripts(docs, 1) - 1 AS place FROM b WHERE conv_id % 5 <> 2)
  SELECT conv_id AS batch_id, CASE WHEN conv_id % 2 = 0 THEN 'id' || place ELSE 'doc_' || place || '_' || md5(document) END AS id, document, 'ok' AS status FROM e UNION ALL SELECT conv_id, NULL, NULL, 'error' FROM b WHERE conv_id % 5 = 2""")
def store_batches(t: Tables) -> DataFrame:
    """Raw batches with and without ids; in every fifth a vector is missing."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    b = t.conversations.groupBy("conv_id").agg(texts.alias("documents"))
    n = F.size("documents")
    vectors = F.array_repeat(F.array(F.lit(0.0)), F.when(F.col("conv_id") % 5 == 2, n - 1).otherwise(n))
    ids = F.when(F.col("conv_id") % 2 == 0, F.transform("documents", lambda x, i: F.concat(F.lit("id"), i.cast("string"))))
    return R.store_rows(b.select(F.col("conv_id").alias("batch_id"), ids.alias("ids"), "documents", F.col("documents").alias("metadatas"), vectors.alias("embeddings"))).select("batch_id", "id", "document", "status")


@query("SELECT doc_id, md5(text) AS hash, lang AS kind FROM documents UNION ALL SELECT doc_id, source AS hash, 'again' FROM documents")
def store_sink(t: Tables) -> DataFrame:
    """Two appends to a store, read again."""
    folder = working_folder(t.spark)
    R.write_store(t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.col("lang").alias("kind")), folder)
    R.write_store(t.documents.select("doc_id", F.col("source").alias("hash"), F.lit("again").alias("kind")), folder)
    return t.spark.read.parquet(folder).select("doc_id", "hash", "kind")


@query("SELECT 0::BIGINT AS rows, 'doc_id,source' AS columns")
def store_clear(t: Tables) -> DataFrame:
    folder = working_folder(t.spark)
    R.write_store(t.documents.select("doc_id", "source"), folder)
    R.clear_store(t.spark, folder)
    left = t.spark.read.parquet(folder)
    return left.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(",".join(left.columns)))


@query("SELECT doc_id, quality, toxic FROM labels")
def json_sink(t: Tables) -> DataFrame:
    folder = working_folder(t.spark)
    R.write_json(t.labels, folder)
    return t.spark.read.schema(t.labels.schema).json(folder).select("doc_id", "quality", "toxic")


@query("SELECT doc_id, lang || ', ' || source AS metadata_tags, n_chars AS metadata_size FROM documents")
def csv_sink(t: Tables) -> DataFrame:
    """Metadata flattened to columns, its lists joined by commas."""
    folder = working_folder(t.spark)
    R.write_csv(t.documents.select("doc_id", F.struct(F.array("lang", "source").alias("tags"), F.col("n_chars").alias("size")).alias("metadata")), folder)
    return t.spark.read.option("header", True).schema("doc_id long, metadata_tags string, metadata_size long").csv(folder)


def _judged(t: Tables) -> DataFrame:
    """Three judges' scores of each benchmark row, from the lengths of its texts."""
    judges = F.array(*(F.struct(F.lit(f"judge {k}").alias("judge"), overall_score(k).alias("overall"), score(k, 1).alias("accuracy"), score(k, 2).alias("sensitivity"), score(k, 3).alias("completeness"), F.concat(F.lit("first\n"), "text").alias("reasoning"), (overall_score(k) < 1.0).alias("outlier")) for k in (1, 2, 3)))
    rows = t.benchmark.select((F.col("item_id") + 1).alias("number"), "text", judges.alias("judges"))
    overall = F.transform("judges", lambda j: j["overall"])
    mean = F.aggregate(overall, F.lit(0.0), lambda a, x: a + x) / 3
    rows = rows.withColumns({"mean": mean, "median": F.element_at(F.array_sort(overall), 2)})
    deviation = F.sqrt(F.aggregate(overall, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / 2)
    return rows.select("number", F.lit(100).alias("total"), F.concat(F.lit("Question "), F.col("number").cast("string")).alias("question"), F.lit("gold").alias("gold"), F.lit("said").alias("answer"), "judges", "mean", "median", deviation.alias("deviation"), F.col("median").alias("final"))


def score(judge: int, part: int) -> Column:
    return ((F.length("text") * judge + part) % 11) / 2.0


def overall_score(judge: int) -> Column:
    """The mean of a judge's three scores."""
    return (score(judge, 1) + score(judge, 2) + score(judge, 3)) / 3


def _overall_sql(judge: int) -> str:
    return f"(({' + '.join(_score_sql(judge, part) for part in (1, 2, 3))}) / 3)"


def _score_sql(judge: int, part: int) -> str:
    return f"((length(text) * {judge} + {part}) % 11) / 2.0"


_NL = "chr(10)"
_BAR, _RULE = "repeat('=', 80)", "repeat('─', 80)"
_JUDGE_SQL = " || ".join(
    f"'Judge: judge {k}' || CASE WHEN {_overall_sql(k)} < 1.0 THEN ' [OUTLIER]' ELSE '' END || printf(chr(10) || '  Overall Score:           %.2f/5' || chr(10) || '  - Factual Accuracy:      %.2f/5' || chr(10) || '  - Cultural Sensitivity:  %.2f/5' || chr(10) || '  - Completeness:          %.2f/5' || chr(10), {_overall_sql(k)}, {_score_sql(k, 1)}, {_score_sql(k, 2)}, {_score_sql(k, 3)}) || '  ' || chr(10) || '  Reasoning:' || chr(10) || '  first' || chr(10) || '  ' || replace(text, chr(10), chr(10) || '  ') || chr(10) || chr(10)"
    for k in (1, 2, 3)
)


@query(f"""WITH s AS (SELECT item_id + 1 AS number, text, {', '.join(f'{_overall_sql(k)} AS s{k}' for k in (1, 2, 3))} FROM benchmark),
  m AS (SELECT *, (s1 + s2 + s3) / 3 AS mean, list_sort([s1, s2, s3])[2] AS median, list_filter(['judge 1', 'judge 2', 'judge 3'], lambda j: ([s1, s2, s3])[substr(j, 7)::INT] < 1.0) AS gone FROM s),
  d AS (SELECT *, sqrt(((s1 - mean) * (s1 - mean) + (s2 - mean) * (s2 - mean) + (s3 - mean) * (s3 - mean)) / 2) AS deviation FROM m)
  SELECT number, CASE WHEN number = 1 THEN {_BAR} || {_NL} || 'DETAILED EVALUATION REPORT' || {_NL} || {_BAR} || {_NL} || {_NL} ELSE '' END || {_NL} || {_BAR} || {_NL} || 'EVALUATION ' || number || '/100' || {_NL} || {_BAR} || {_NL} || {_NL}
  || 'QUESTION:' || {_NL} || 'Question ' || number || {_NL} || {_NL} || 'GOLDEN ANSWER:' || {_NL} || 'gold' || {_NL} || {_NL} || 'MODEL ANSWER:' || {_NL} || 'said' || {_NL} || {_NL} || {_RULE} || {_NL} || 'JUDGE EVALUATIONS:' || {_NL} || {_RULE} || {_NL} || {_NL} || {_JUDGE_SQL}
  || {_RULE} || {_NL} || 'STATISTICAL SUMMARY:' || {_NL} || {_RULE} || {_NL} || printf('Mean Score (all judges):     %.2f/5' || chr(10) || 'Median Score:                %.2f/5' || chr(10) || 'Standard Deviation:          %.2f' || chr(10), mean, median, deviation)
  || CASE WHEN len(gone) > 0 THEN 'Outliers Detected:           ' || array_to_string(gone, ', ') || {_NL} || printf('Final Score (outliers removed): %.2f/5', median) ELSE 'Outliers Detected:           None' || {_NL} || printf('Final Score:                 %.2f/5', median) END || {_NL} || {_NL} AS report FROM d""")
def judge_reports(t: Tables) -> DataFrame:
    return R.judge_report(_judged(t), "DETAILED EVALUATION REPORT")


_RANGES = {"0-3 (Poor)": "f < 3", "3-5 (Fair)": "f >= 3 AND f < 5", "5-7 (Good)": "f >= 5 AND f < 7", "7-9 (Very Good)": "f >= 7 AND f < 9", "9-10 (Excellent)": "f >= 9 AND f <= 10"}


@query(f"""WITH s AS (SELECT {', '.join(f'{_overall_sql(k)} AS s{k}' for k in (1, 2, 3))} FROM benchmark), f AS (SELECT *, list_sort([s1, s2, s3])[2] AS f, greatest(s1, s2, s3) - least(s1, s2, s3) <= 1.0 AS agree FROM s),
  o AS (SELECT 'judge ' || k AS judge, count(*) AS n FROM (SELECT unnest([1, 2, 3]) AS k, unnest([s1, s2, s3]) AS x FROM s) WHERE x < 1.0 GROUP BY k)
  SELECT {_BAR} || {_NL} || 'STATISTICAL SUMMARY' || {_NL} || {_BAR} || {_NL} || {_NL} || 'Total Evaluations: ' || count(*) || {_NL} || {_NL} || 'SCORE STATISTICS' || {_NL} || repeat('-', 80) || {_NL}
  || printf('Mean Final Score:   %.2f/5' || chr(10) || 'Median Final Score: %.2f/5' || chr(10) || 'Std Deviation:      %.2f' || chr(10) || 'Min Score:          %.2f/5' || chr(10) || 'Max Score:          %.2f/5' || chr(10) || chr(10), avg(f), median(f), stddev_pop(f), min(f), max(f))
  || 'SCORE DISTRIBUTION' || {_NL} || repeat('-', 80) || {_NL} || {' || '.join(f"printf('%-20s %3d (%5.1f%%)' || chr(10), '{k}', count(*) FILTER ({c}), 100.0 * count(*) FILTER ({c}) / count(*))" for k, c in _RANGES.items())}
  || {_NL} || 'OUTLIER STATISTICS' || {_NL} || repeat('-', 80) || {_NL} || coalesce((SELECT string_agg(printf('%-20s %3d outliers (%5.1f%%)' || chr(10), judge, n, 100.0 * n / (SELECT count(*) FROM s)), '' ORDER BY judge) FROM o), 'No outliers detected' || {_NL})
  || {_NL} || 'JUDGE AGREEMENT RATE' || {_NL} || repeat('-', 80) || {_NL} || printf('Judges agree (within 1 point): %.1f%%' || chr(10), 100.0 * count(*) FILTER (agree) / count(*)) AS report FROM f""")
def judge_summary(t: Tables) -> DataFrame:
    return R.summary_report(R.summary_of(_judged(t)), "STATISTICAL SUMMARY")


_VECTORS = f"""WITH s AS ({EMBED.replace('% 16', '% 64')}), v AS (SELECT item_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS value FROM s), g AS (SELECT item_id, unnest(range(64)) AS slot FROM benchmark)
  SELECT g.item_id, list(round(coalesce(v.value, 0.0), 6) ORDER BY g.slot) AS vector FROM g LEFT JOIN v ON v.item_id = g.item_id AND v.slot = g.slot GROUP BY g.item_id"""


@query(f"{_VECTORS} UNION ALL SELECT -1, []")
def embed_batch(t: Tables) -> DataFrame:
    """The embedder over a column; a blank text has an empty vector."""
    texts = t.benchmark.select("item_id", "text").unionByName(t.spark.sql("SELECT -1L AS item_id, '  ' AS text"))
    return texts.select("item_id", F.transform(hash_embedder()("text"), lambda x: F.round(x, 6)).alias("vector"))


@query(f"SELECT v.*, 0::BIGINT AS embedded_again FROM ({_VECTORS}) v")
def cached_vectors(t: Tables) -> DataFrame:
    """The vectors of a second run, which embeds nothing: the first one has kept them all."""
    folder = working_folder(t.spark)
    for _ in range(2):
        cache = EmbeddingCache(t.spark, folder, "terms-64", hash_embedder())
        out = cache.vectors(t.benchmark.select("item_id", "text"))
    return out.select("item_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), F.lit(cache.embedded).cast("long").alias("embedded_again"))


@query(f"""WITH v AS ({_VECTORS}) SELECT v.item_id AS id, CASE WHEN v.item_id % 4 = 1 THEN 'changed' ELSE b.text END AS text, v.vector FROM v JOIN benchmark b USING (item_id) WHERE v.item_id % 5 <> 0""")
def store_with_vectors(t: Tables) -> DataFrame:
    """Rows added with their vectors, some changed, some deleted; the store as it is read again."""
    folder = working_folder(t.spark)
    cache, store = EmbeddingCache(t.spark, f"{folder}/cache", "terms-64", hash_embedder()), VectorStore(t.spark, f"{folder}/store")
    rows = cache.vectors(t.benchmark.select(F.col("item_id").alias("id"), "text"))
    store.upsert(rows)
    store.upsert(rows.where("id % 4 = 1").withColumn("text", F.lit("changed")))
    store.delete(rows.where("id % 5 = 0").select("id"))
    return store.rows().select("id", "text", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, []::VARCHAR[] AS ancestors, r_name AS content FROM region UNION ALL SELECT 'n' || n_nationkey, ['r' || n_regionkey], n_name FROM nation)
  SELECT * FROM n UNION ALL SELECT 'new', ['r' || n_regionkey, 'n5'], 'child' FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 'beside', ['r' || n_regionkey], 'sibling' FROM nation WHERE n_nationkey = 7""")
def tree_append(t: Tables) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    roots = t.region.select(name("r", "r_regionkey").alias("id"), F.array().cast("array<string>").alias("ancestors"), F.col("r_name").alias("content"))
    leaves = t.nation.select(name("n", "n_nationkey").alias("id"), F.array(name("r", "n_regionkey")).alias("ancestors"), F.col("n_name").alias("content"))
    return trees.add_sibling(trees.add_child(roots.unionByName(leaves), F.lit("n5"), "new", "child"), F.lit("n7"), "beside", "sibling")


@query("SELECT c_custkey, to_json({'keep': c_mktsegment, 'size': c_nationkey}) AS metadata FROM customer")
def drop_metadata_field(t: Tables) -> DataFrame:
    """A field goes from a struct, whatever else is in it."""
    given = t.customer.select("c_custkey", F.struct(F.col("c_mktsegment").alias("keep"), F.struct(F.lit("x").alias("by")).alias("refinement_info"), F.col("c_nationkey").alias("size")).alias("metadata"))
    return scores.without_field(given, "metadata", "refinement_info").withColumn("metadata", F.to_json("metadata"))


@query("""SELECT conv_id, coalesce(string_agg(CASE WHEN trim(text) LIKE '%?' THEN trim(text) ELSE trim(text) || '?' END, '' ORDER BY turn) FILTER (trim(text) <> ''), '') AS questions FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def question_file(t: Tables) -> DataFrame:
    """All questions of a dataset as one text, each with its mark; a conversation is a dataset."""
    return scores.question_text(t.conversations.where("role = 'user'"), ["conv_id"], "turn", "text")


@query("""SELECT o_orderkey, action, CASE WHEN action IN ('refine_answer', 'refine_both') AND o_orderkey % 3 <> 0 THEN 'better ' || o_orderpriority ELSE o_orderpriority END AS answer, action IN ('refine_answer', 'refine_both') AS asked
  FROM (SELECT *, (['none', 'refine_question', 'refine_answer', 'refine_both'])[(o_orderkey % 4 + 1)::INT] AS action FROM orders)""")
def refine_apply(t: Tables) -> DataFrame:
    """Only answers are refined; a reply that does not parse leaves the answer as it is."""
    action = F.element_at(F.array(*map(F.lit, ("none", "refine_question", "refine_answer", "refine_both"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    items = t.orders.select("o_orderkey", action.alias("action"), F.col("o_orderpriority").alias("answer"))
    reply = lambda answer: F.when(F.col("o_orderkey") % 3 == 0, "no such line").otherwise(F.concat(F.lit("REASONING: x\nREFINED_ANSWER: better "), answer))
    return scores.refined(items, reply).select("o_orderkey", "action", "answer", "asked")


_METRICS_SQL = {m: f1_sql(TERMS.replace("text", a), TERMS.replace("text", b)) for m, (a, b) in {"faithfulness": ("answer", "context"), "answer_correctness": ("answer", "truth"), "context_recall": ("truth", "context"), "context_precision": ("context", "truth"), "answer_relevancy": ("answer", "question"), "answer_similarity": ("truth", "answer")}.items()}


@query(f"""WITH i AS (SELECT b.item_id, split_part(b.text, '.', 1) AS question, CASE WHEN b.item_id % 5 = 0 THEN NULL ELSE d.text END AS context, b.text AS truth, substr(b.text, 20) AS answer FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
  s AS (SELECT item_id, {', '.join(f'CASE WHEN context IS NULL AND {int("context" in m or m == "faithfulness")} = 1 THEN NULL ELSE round({e}, 6) END::DOUBLE AS {m}' for m, e in _METRICS_SQL.items())} FROM i)
  SELECT *, round(list_avg(list_filter([{', '.join(_METRICS_SQL)}], lambda x: x IS NOT NULL)), 6) AS overall FROM s""")
def answer_metrics(t: Tables) -> DataFrame:
    """The six metrics with scorers plugged in (term-set F1 here), and their mean over those that are there."""
    docs = t.documents.select("doc_id", F.col("text").alias("context"))
    items = t.benchmark.join(docs, F.col("item_id") == F.col("doc_id"))
    items = items.select("item_id", F.split_part("text", F.lit("."), F.lit(1)).alias("question"), F.when(F.col("item_id") % 5 != 0, F.col("context")).alias("context"), F.col("text").alias("truth"), F.expr("substr(text, 20)").alias("answer"))
    return scores.metrics(items, scores.LEXICAL)


@query(f"""WITH {ASKED}, docs AS (SELECT doc_id, text FROM documents), {BM25}, c AS (SELECT item_id, text, CASE WHEN item_id % 40 = 0 THEN 'Factual' ELSE 'Analytical' END AS kind FROM benchmark WHERE item_id % 20 = 0),
  x AS (SELECT query_id AS item_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS section FROM bm JOIN docs USING (doc_id) WHERE rank <= 5 GROUP BY query_id)
  SELECT item_id, concat_ws(chr(10) || repeat('-', 80) || chr(10), 'Answer from the contexts.', 'CONTEXT:' || chr(10) || section, CASE kind WHEN 'Factual' THEN 'State the fact first.' END, 'EXAMPLE:' || chr(10) || kind, 'QUESTION: ' || split_part(text, '.', 1) || '?') AS prompt FROM c JOIN x USING (item_id)""")
def prompt_build(t: Tables) -> DataFrame:
    """A prompt from what the other steps found: each question's search results, the guideline if there is one, exemplars, the question."""
    kind = F.when(F.col("item_id") % 40 == 0, "Factual").otherwise("Analytical")
    found = S.with_rows(t.keyword_index().search(questions_asked(t)), t.documents.select("doc_id", "text"))
    contexts = found.groupBy(F.col("query_id").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))  # k a question
    rows = t.benchmark.where("item_id % 20 = 0").join(contexts, "item_id")
    return rows.select("item_id", scores.prompt("Answer from the contexts.", F.col("contexts"), F.when(kind == "Factual", "State the fact first."), F.array(kind), F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.lit("?"))).alias("prompt"))


@query()
def chunk_strategies(t: Tables) -> DataFrame:
    """Strategies that need a model fall back to the recursive one."""
    sums = lambda chunks: chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))
    return prepare.chunked_by_each(t.documents.select("doc_id", "text"), ["recursive", "semantic"], sums)
