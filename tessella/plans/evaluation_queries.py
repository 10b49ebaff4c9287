"""Queries over evaluations, judges, dataset merges, message trees and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rollups, scores, trees
from ..operators import search as S
from ..operators.prepare import numbered
from ..sources import readers
from ..sources.scratch import working_folder
from .catalog import Cases, Tables, query
from .search_queries import f1_sql

# ---- retrieval metrics; items: documents, truth from labels, similarity derived from n_chars

ITEMS = "SELECT d.doc_id AS item, coalesce(l.quality, 0) = 1 AS truth, round((d.n_chars % 1000) / 1000.0, 6)::DOUBLE AS sim, d.doc_id % 5 AS idx, d.doc_id % 17 = 0 AS failed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _items(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("item"), (F.coalesce("quality", F.lit(0)) == 1).alias("truth"), F.round((F.col("n_chars") % 1000) / 1000.0, 6).alias("sim"), (F.col("doc_id") % 5).alias("idx"), (F.col("doc_id") % 17 == 0).alias("failed"))


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0; six places."""
    return F.round(F.when(b != 0, a.cast("double") / b).otherwise(0.0), 6)


@query(f"""WITH i AS ({ITEMS}), c AS (SELECT count(*) FILTER (truth AND sim >= 0.675) AS tp, count(*) FILTER (NOT truth AND sim >= 0.675) AS fp, count(*) FILTER (truth AND sim < 0.675) AS fn, count(*) FILTER (NOT truth AND sim < 0.675) AS tn FROM i WHERE NOT failed)
  SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def confusion_metrics(t: Tables) -> DataFrame:
    hit, truth = F.col("sim") >= 0.675, F.col("truth")
    c = _items(t).where("not failed").agg(count_if(truth & hit).alias("tp"), count_if(~truth & hit).alias("fp"), count_if(truth & ~hit).alias("fn"), count_if(~truth & ~hit).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tp + tn, tp + fp + fn + tn).alias("accuracy"))


@query(f"""WITH i AS ({ITEMS}), k(k) AS (VALUES (1), (3), (5)), c AS (SELECT k, count(*) FILTER (NOT failed) AS n, count(*) FILTER (truth AND NOT failed) AS truths, count(*) FILTER (truth AND NOT failed AND idx < k AND sim >= 0.675) AS hits FROM i, k GROUP BY k)
  SELECT k::BIGINT AS k, hits, round(hits / (n * k), 6) AS precision, round(hits / truths, 6) AS recall FROM c""")
def metrics_at_k(t: Tables) -> DataFrame:
    ks = t.rows("(1L), (3L), (5L)", "k")
    ok = ~F.col("failed")
    c = _items(t).crossJoin(F.broadcast(ks)).groupBy("k").agg(count_if(ok).alias("n"), count_if(ok & F.col("truth")).alias("truths"), count_if(ok & F.col("truth") & (F.col("idx") < F.col("k")) & (F.col("sim") >= 0.675)).alias("hits"))
    return c.select("k", "hits", safe(F.col("hits"), F.col("n") * F.col("k")).alias("precision"), safe(F.col("hits"), F.col("truths")).alias("recall"))


@query(f"WITH i AS ({ITEMS}) SELECT round(avg(sim), 6) AS mean, round(median(sim), 6) AS median, round(stddev_pop(sim), 6) AS std, min(sim) AS low, max(sim) AS high, round(100.0 * count(*) FILTER (sim >= 0.675) / count(*), 6)::DOUBLE AS above, round(100.0 * count(*) / (SELECT count(*) FROM i), 6)::DOUBLE AS success FROM i WHERE NOT failed")
def similarity_stats(t: Tables) -> DataFrame:
    ok = lambda c: F.when(~F.col("failed"), c)
    sim = ok(F.col("sim"))
    return _items(t).agg(F.round(F.avg(sim), 6).alias("mean"), F.round(F.median(sim), 6).alias("median"), F.round(F.stddev_pop(sim), 6).alias("std"), F.min(sim).alias("low"), F.max(sim).alias("high"), F.round(100.0 * count_if(sim >= 0.675) / F.count(sim), 6).alias("above"), F.round(100.0 * F.count(sim) / F.count("*"), 6).alias("success"))


_FORM = r"regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"


def _tokens_sql(e: str) -> str:
    return f"list_filter({_FORM.format(e)}, lambda x: x <> '')"


_tokens = scores.tokens


_TRUTH = "SELECT a.conv_id, a.turn, a.text AS answer, b.text AS truth FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _turns(t: Tables) -> DataFrame:
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("answer"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    return a.join(b, ["conv_id", "turn"])


@query(f"WITH p AS ({_TRUTH}) SELECT conv_id, turn, round({f1_sql(_tokens_sql('answer'), _tokens_sql('truth'))}, 6)::DOUBLE AS f1 FROM p")
def token_f1(t: Tables) -> DataFrame:
    return _turns(t).select("conv_id", "turn", F.round(S.lexical_f1(_tokens(F.col("answer")), _tokens(F.col("truth"))), 6).alias("f1"))


_NONE = " OR ".join(f"contains(lower(answer), '{p}')" for p in scores.NO_INFORMATION)
#: Turns with the next one as their truth, and the two before them as their contexts.
_WITH_CONTEXTS = f"""p AS ({_TRUTH}), c AS (SELECT p.conv_id, p.turn, p.answer, p.truth, list(x.text ORDER BY x.turn) FILTER (x.text IS NOT NULL) AS contexts FROM p LEFT JOIN conversations x ON x.conv_id = p.conv_id AND x.turn BETWEEN p.turn - 2 AND p.turn - 1 GROUP BY ALL)"""


def _grounded_sql(threshold: float) -> str:
    own, other = f"list_distinct({_tokens_sql('answer')})", f"list_distinct({_tokens_sql('x')})"
    return f"(answer <> '' AND NOT ({_NONE}) AND len({own}) > 0 AND len(list_filter(coalesce(contexts, []), lambda x: len(list_intersect({own}, {other})) / len({own}) >= {threshold})) > 0)"


def _with_contexts(t: Tables) -> DataFrame:
    """Joined by conversation and turn, so that a long conversation is no group."""
    out = _turns(t)
    for k in (1, 2):
        before = t.conversations.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"before_{k}"))
        out = out.join(before, ["conv_id", "turn"], "left")
    contexts = F.filter(F.array("before_2", "before_1"), lambda c: c.isNotNull())
    return out.select("conv_id", "turn", "answer", "truth", contexts.alias("contexts"))


@query(f"WITH {_WITH_CONTEXTS} SELECT conv_id, turn, {_grounded_sql(0.5)} AS grounded, {_grounded_sql(0.1)} AS loosely_grounded FROM c")
def grounding(t: Tables) -> DataFrame:
    """Against the two turns before, at the default threshold; beside it at one that these texts reach."""
    answer, contexts = F.col("answer"), F.col("contexts")
    return _with_contexts(t).select("conv_id", "turn", scores.grounded(answer, contexts).alias("grounded"), scores.grounded(answer, contexts, 0.1).alias("loosely_grounded"))


#: Aligned tokens: idf over the truths, a vector for each distinct token, and each token's largest cosine with the other side.
_ALIGNED = f"""p AS ({_TRUTH}), side AS (SELECT conv_id, turn, 0 AS side, unnest({_tokens_sql('answer')}) AS token FROM p UNION ALL SELECT conv_id, turn, 1, unnest({_tokens_sql('truth')}) FROM p),
  held AS (SELECT token, count(DISTINCT (conv_id, turn)) AS held FROM side WHERE side = 1 GROUP BY token), idf AS (SELECT token, ln(((SELECT count(*) FROM p) + 1) / (coalesce(held, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT token FROM side) LEFT JOIN held USING (token)),
  slots AS (SELECT token, list_transform(range(1, len('#' || token || '#') - 1), lambda i: ('0x' || substr(md5(substr('#' || token || '#', i, 3)), 1, 8))::BIGINT % {scores.WIDTH}) AS s FROM idf),
  vec AS (SELECT token, list_transform(range(0, {scores.WIDTH}), lambda k: len(list_filter(s, lambda x: x = k))::DOUBLE) AS v FROM slots),
  w AS (SELECT conv_id, turn, side, token, count(*) * any_value(idf) AS w, any_value(v) AS v FROM side JOIN idf USING (token) JOIN vec USING (token) GROUP BY ALL),
  m AS (SELECT a.conv_id, a.turn, a.side, a.token, any_value(a.w) AS w, max(list_cosine_similarity(a.v, b.v)) AS m FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.side <> b.side GROUP BY ALL),
  pr AS (SELECT conv_id, turn, sum(w * m) FILTER (side = 0) / sum(w) FILTER (side = 0) AS p, sum(w * m) FILTER (side = 1) / sum(w) FILTER (side = 1) AS r FROM m GROUP BY ALL),
  al AS (SELECT p.conv_id, p.turn, p.answer, p.truth, CASE WHEN pr.p IS NOT NULL THEN pr.p WHEN len({_tokens_sql('p.answer')}) = 0 AND len({_tokens_sql('p.truth')}) = 0 THEN 1.0 ELSE 0.0 END AS precision,
    CASE WHEN pr.r IS NOT NULL THEN pr.r WHEN len({_tokens_sql('p.answer')}) = 0 AND len({_tokens_sql('p.truth')}) = 0 THEN 1.0 ELSE 0.0 END AS recall FROM p LEFT JOIN pr USING (conv_id, turn)),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM al)"""


def _six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"WITH {_ALIGNED} SELECT conv_id, turn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def semantic_alignment(t: Tables) -> DataFrame:
    """BERTScore's alignment of tokens, over the embedder that needs no model."""
    return scores.alignment(_turns(t), ["conv_id", "turn"]).select("conv_id", "turn", *_six("precision", "recall", "f1"))


@query(f"WITH {_ALIGNED} SELECT CASE WHEN f1 > 0.93 THEN 'excellent' WHEN f1 > 0.90 THEN 'good' WHEN f1 > 0.70 THEN 'acceptable' ELSE 'poor' END AS tier, count(*) AS n FROM f GROUP BY 1")
def answer_tiers(t: Tables) -> DataFrame:
    return scores.alignment(_turns(t), ["conv_id", "turn"]).groupBy(scores.tier(F.col("f1")).alias("tier")).agg(F.count("*").alias("n"))


_LEVELS = {"excellent": "semantic > 0.93", "good": "semantic > 0.90 AND semantic <= 0.93", "acceptable": "semantic > 0.70 AND semantic <= 0.90", "poor": "semantic <= 0.70"}


_SYSTEM = f"""WITH {_WITH_CONTEXTS}, {_ALIGNED.replace('p AS (' + _TRUTH + '), ', '', 1)},
  i AS (SELECT f.f1 AS semantic, {f1_sql(_tokens_sql('c.answer'), _tokens_sql('c.truth'))} AS lexical, {_grounded_sql(0.5).replace('answer', 'c.answer')} AS grounded, len(coalesce(contexts, [])) > 0 AS has_context,
    CASE WHEN c.turn % 3 = 0 THEN (length(c.truth) % 11) / 10.0 END AS relevance FROM c JOIN f USING (conv_id, turn))
  SELECT count(*) AS total_questions, {', '.join(f'count(*) FILTER ({c}) AS {k}_answers' for k, c in _LEVELS.items())}, {', '.join(f'round(count(*) FILTER ({c}) / count(*), 6) AS {k}_rate' for k, c in _LEVELS.items() if k != 'poor')},
    round(count(*) FILTER (semantic > 0.70) / count(*), 6) AS overall_quality_rate, count(*) FILTER (grounded) AS grounded_answers, count(*) FILTER (has_context) AS questions_with_context,
    round(count(*) FILTER (grounded) / count(*), 6) AS grounding_rate, round(count(*) FILTER (has_context) / count(*), 6) AS context_availability_rate, round(avg(semantic), 6) AS avg_semantic_score, round(avg(lexical), 6)::DOUBLE AS avg_f1_score,
    count(relevance) AS relevance_scores, round(avg(relevance), 6)::DOUBLE AS avg_relevance, min(relevance)::DOUBLE AS min_relevance, max(relevance)::DOUBLE AS max_relevance FROM i"""


@query(_SYSTEM)
def system_metrics(t: Tables) -> DataFrame:
    """Tiers by aligned tokens, lexical F1, grounding in the turns before; a relevance that every third turn has."""
    turns = _with_contexts(t)
    semantic = scores.alignment(turns, ["conv_id", "turn"]).select("conv_id", "turn", F.col("f1").alias("semantic"))
    lexical = S.lexical_f1(_tokens(F.col("answer")), _tokens(F.col("truth")))
    relevance = F.when(F.col("turn") % 3 == 0, F.length("truth") % 11 / 10.0)
    items = turns.join(semantic, ["conv_id", "turn"]).select("semantic", lexical.alias("lexical"), scores.grounded(F.col("answer"), F.col("contexts")).alias("grounded"), (F.size("contexts") > 0).alias("has_context"), relevance.alias("relevance"))
    return scores.system_metrics(items)


@query(f"""WITH m AS ({_SYSTEM}) SELECT repeat('=', 70) || chr(10) || 'Q&A SYSTEM EDUCATIONAL SUITABILITY (SEMANTIC EVALUATION)' || chr(10) || repeat('=', 70) || chr(10) || 'Total Questions Evaluated: ' || total_questions || chr(10) || chr(10)
  || repeat('-', 70) || chr(10) || 'SEMANTIC ACCURACY (BERTScore)' || chr(10) || repeat('-', 70) || chr(10) || printf('Average BERTScore:       %.4f' || chr(10) || '(Legacy Lexical F1):     %.4f' || chr(10) || chr(10), avg_semantic_score, avg_f1_score) || 'Semantic Quality Distribution:' || chr(10)
  || printf('  Excellent (>0.93):     %.2f%% (%d)' || chr(10) || '  Good (>0.90):          %.2f%% (%d)' || chr(10) || '  Acceptable (>0.70):    %.2f%% (%d)' || chr(10) || '  Poor (<=0.70):         %.2f%% (%d)' || chr(10) || chr(10), 100 * excellent_rate, excellent_answers, 100 * good_rate, good_answers, 100 * acceptable_rate, acceptable_answers, 100.0 * poor_answers / total_questions, poor_answers)
  || printf('Overall Semantic Pass Rate: %.2f%%' || chr(10) || chr(10), 100 * overall_quality_rate) || repeat('-', 70) || chr(10) || 'RELIABILITY (Grounding)' || chr(10) || repeat('-', 70) || chr(10) || printf('Grounding Rate:          %.2f%%' || chr(10) || 'Context Availability:    %.2f%%', 100 * grounding_rate, 100 * context_availability_rate) AS report FROM m""")
def system_report(t: Tables) -> DataFrame:
    return readers.quality_report(system_metrics(t))


@query("SELECT CASE WHEN s > 0.93 THEN 'excellent' WHEN s > 0.90 THEN 'good' WHEN s > 0.70 THEN 'fair' ELSE 'poor' END AS tier, count(*) AS n FROM (SELECT (n_chars % 1000) / 1000.0 AS s FROM documents) GROUP BY 1")
def tiering(t: Tables) -> DataFrame:
    s = (F.col("n_chars") % 1000) / 1000.0
    tier = F.when(s > 0.93, "excellent").when(s > 0.90, "good").when(s > 0.70, "fair").otherwise("poor")
    return t.documents.select(tier.alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT doc_id, [CASE WHEN doc_id % 2 = 0 THEN 0.5 END, CASE WHEN doc_id % 3 = 0 THEN 0.7 END, CASE WHEN doc_id % 5 = 0 THEN 0.9 END]::DOUBLE[] AS x FROM documents)
  SELECT doc_id, round(coalesce(list_avg(list_filter(x, lambda v: v IS NOT NULL)), 0.0), 6) AS overall FROM m""")
def nullaware_mean(t: Tables) -> DataFrame:
    x = F.array(*(F.when(F.col("doc_id") % m == 0, F.lit(v)) for m, v in ((2, 0.5), (3, 0.7), (5, 0.9))))
    known = F.filter(x, lambda v: v.isNotNull())
    return t.documents.select("doc_id", F.round(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)).otherwise(0.0), 6).alias("overall"))


# ---- judges: parts of orders as questions, their lines as judges

JUDGES = "SELECT l_orderkey AS question, l_linenumber AS judge, round((l_quantity + l_linenumber) % 9 / 2.0 + 1 + CASE WHEN l_partkey % 37 = 0 THEN 20 ELSE 0 END, 6)::DOUBLE AS score FROM lineitem"
_STATS = f"WITH j AS ({JUDGES}), z AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS std FROM j WINDOW w AS (PARTITION BY question)), o AS (SELECT *, n >= 3 AND std > 0 AND round(abs(score - mean) / std, 9) > 2.0 AS outlier FROM z)"


def _judges(t: Tables) -> DataFrame:
    extra = F.when(F.col("l_partkey") % 37 == 0, 20).otherwise(0)
    return t.lineitem.select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("judge"), F.round((F.col("l_quantity") + F.col("l_linenumber")) % 9 / 2.0 + 1 + extra, 6).alias("score"))


def outliers(scores: DataFrame, limit: float = 2.0) -> DataFrame:
    """scores (question, judge, score) with (n, mean, std, outlier): |z| above the limit, from three judges on."""
    w = Window.partitionBy("question")
    z = scores.withColumns({"n": F.count("*").over(w), "mean": F.avg("score").over(w), "std": F.stddev_pop("score").over(w)})
    return z.withColumn("outlier", (F.col("n") >= 3) & (F.col("std") > 0) & (F.round(F.abs(F.col("score") - F.col("mean")) / F.nullif("std", F.lit(0.0)), 9) > limit)).withColumn("outlier", F.coalesce("outlier", F.lit(False)))


@query(f"{_STATS} SELECT question, judge, score FROM o WHERE outlier")
def zscore_outliers(t: Tables) -> DataFrame:
    return outliers(_judges(t)).where("outlier").select("question", "judge", "score")


@query(f"{_STATS} SELECT question, count(*) AS judges, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS std, round(avg(score) FILTER (NOT outlier), 6) AS final FROM o GROUP BY question")
def question_stats(t: Tables) -> DataFrame:
    return outliers(_judges(t)).groupBy("question").agg(F.count("*").alias("judges"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.median("score"), 6).alias("median"), F.round(F.stddev_pop("score"), 6).alias("std"), F.round(F.avg(F.when(~F.col("outlier"), F.col("score"))), 6).alias("final"))


@query(f"{_STATS} SELECT judge, count(*) FILTER (outlier) AS outliers, count(*) AS scores FROM o GROUP BY judge")
def outlier_counts(t: Tables) -> DataFrame:
    return outliers(_judges(t)).groupBy("judge").agg(count_if(F.col("outlier")).alias("outliers"), F.count("*").alias("scores"))


@query(f"WITH j AS ({JUDGES}) SELECT CASE WHEN score < 3 THEN '<3' WHEN score < 5 THEN '3-5' WHEN score < 7 THEN '5-7' WHEN score < 9 THEN '7-9' ELSE '9-10' END AS bin, count(*) AS n FROM j GROUP BY 1")
def score_histogram(t: Tables) -> DataFrame:
    s = F.col("score")
    return _judges(t).select(F.when(s < 3, "<3").when(s < 5, "3-5").when(s < 7, "5-7").when(s < 9, "7-9").otherwise("9-10").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"WITH j AS ({JUDGES}), q AS (SELECT question, count(*) AS n, max(score) - min(score) AS spread FROM j GROUP BY question) SELECT round(100.0 * count(*) FILTER (spread <= 1) / count(*), 6)::DOUBLE AS agreement, count(*) AS questions FROM q WHERE n >= 2")
def agreement_rate(t: Tables) -> DataFrame:
    q = _judges(t).groupBy("question").agg(F.count("*").alias("n"), (F.max("score") - F.min("score")).alias("spread")).where("n >= 2")
    return q.agg(F.round(100.0 * count_if(F.col("spread") <= 1) / F.count("*"), 6).alias("agreement"), F.count("*").alias("questions"))


@query(f"WITH j AS ({JUDGES}) SELECT question, {', '.join(f'max(score) FILTER (judge = {i}) AS judge_{i}' for i in range(1, 5))}, round(avg(score), 6) AS overall FROM j GROUP BY question")
def judge_pivot(t: Tables) -> DataFrame:
    j = _judges(t).groupBy("question")
    return j.agg(*(F.max(F.when(F.col("judge") == i, F.col("score"))).alias(f"judge_{i}") for i in range(1, 5)), F.round(F.avg("score"), 6).alias("overall"))


# ---- dataset merges: orders as entries, customers as the other side

_LAST = "(SELECT o_custkey, max(o_orderkey) AS last, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey)"


def _last(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))


@query(f"SELECT c.c_custkey, CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND r.priority IS NOT NULL THEN r.priority ELSE c.c_mktsegment END AS value, r.last IS NOT NULL AS matched FROM customer c LEFT JOIN {_LAST} r ON r.o_custkey = c.c_custkey")
def refined_merge(t: Tables) -> DataFrame:
    """The right side's last duplicate wins; a row is replaced where its action asks for it."""
    j = t.customer.select("c_custkey", "c_mktsegment").join(_last(t), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("priority").isNotNull(), F.col("priority")).otherwise(F.col("c_mktsegment")).alias("value"), F.col("last").isNotNull().alias("matched"))


_LINES = "(SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS contexts FROM orders GROUP BY o_custkey)"


def _lines(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(F.transform(rows, lambda r: r["o_orderpriority"]).alias("contexts"))


@query(f"SELECT c.c_custkey, c.c_name AS question, r.contexts FROM customer c LEFT JOIN {_LINES} r ON r.o_custkey = c.c_custkey")
def context_merge(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.col("c_name").alias("question")).join(_lines(t), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "question", "contexts")


@query(f"SELECT c.c_custkey, coalesce(array_to_string(r.contexts, ' || '), '') AS contexts FROM customer c LEFT JOIN {_LINES} r ON r.o_custkey = c.c_custkey")
def csv_json_merge(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(_lines(t), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.array_join("contexts", " || "), F.lit("")).alias("contexts"))


@query(f"SELECT c.c_custkey, coalesce(nullif(r.priority, '1-URGENT'), c.c_mktsegment) AS gold FROM customer c LEFT JOIN {_LAST} r ON r.o_custkey = c.c_custkey")
def gold_update(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_mktsegment").join(_last(t), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.nullif("priority", F.lit("1-URGENT")), "c_mktsegment").alias("gold"))


@query("WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderpriority FROM orders), b AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_name FROM customer) SELECT a.i, o_orderpriority, c_name FROM a JOIN b USING (i)")
def positional_zip(t: Tables) -> DataFrame:
    """Rows of two ordered lists side by side, up to the shorter one."""
    a = numbered(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").select("i", "o_orderpriority")
    return a.join(numbered(t.customer.select("c_custkey", "c_name"), "c_custkey").select("i", "c_name"), "i")


STATES = Cases("(1, 'valid', 'valid', 'valid', 'valid'), (2, 'invalid', 'valid', 'valid', 'valid'), (3, 'valid', 'invalid', 'error', 'valid'), (4, 'invalid', 'invalid', 'valid', 'valid'), (5, 'partial', 'error', 'valid', 'invalid'), (6, 'valid', 'valid', 'invalid', 'invalid')", "id, q1, a1, q2, a2", "SELECT 1000 + o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid' ELSE 'valid' END, CASE o_orderkey % 7 WHEN 0 THEN 'invalid' WHEN 1 THEN 'error' ELSE 'valid' END, CASE WHEN o_orderkey % 11 = 0 THEN 'partial' ELSE 'valid' END, CASE WHEN o_orderkey % 3 = 0 THEN 'invalid' ELSE 'valid' END FROM orders")
_ACTION = "SELECT id, CASE WHEN 'invalid' IN (q1, q2) AND 'invalid' IN (a1, a2) THEN 'refine_both' WHEN 'invalid' IN (q1, q2) THEN 'refine_question' WHEN 'invalid' IN (a1, a2) THEN 'refine_answer' ELSE 'none' END AS action FROM " + str(STATES)


def _actions(t: Tables) -> DataFrame:
    """Only the literal invalid is bad: errors and partial verdicts pass."""
    q = (F.col("q1") == "invalid") | (F.col("q2") == "invalid")
    a = (F.col("a1") == "invalid") | (F.col("a2") == "invalid")
    return t.cases(STATES).select("id", F.when(q & a, "refine_both").when(q, "refine_question").when(a, "refine_answer").otherwise("none").alias("action"))


@query(_ACTION)
def refine_action(t: Tables) -> DataFrame:
    return _actions(t)


@query(f"WITH a AS ({_ACTION}) SELECT action, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM a), 6)::DOUBLE AS percent, list(id ORDER BY id)[1:20] AS ids FROM a GROUP BY action")
def refinement_report(t: Tables) -> DataFrame:
    """The number and part of each action, and the first twenty items that it is asked for."""
    a = _actions(t)
    total = F.broadcast(a.agg(F.count("*").alias("total")))
    first = a.withColumn("i", F.row_number().over(Window.partitionBy("action").orderBy("id"))).where(F.col("i") <= 20).groupBy("action").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return a.groupBy("action").agg(F.count("*").alias("n")).join(first, "action").crossJoin(total).select("action", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"), "ids")


JUDGED = Cases("(1, 'STATUS: Valid~REASONING: clear', 'a'), (2, 'text~STATUS: partially valid~REASONING: so so', 'b'), (3, 'STATUS: INVALID', 'c'), (4, 'nothing', 'd')", "id, a, o", "SELECT 1000 + conv_id * 1000 + turn, CASE turn % 4 WHEN 0 THEN 'STATUS: Valid' WHEN 1 THEN 'x~STATUS: partially valid' WHEN 2 THEN 'STATUS: INVALID ' ELSE role END || '~REASONING: ' || role || '~more', role FROM conversations")
_STATUS = f"""SELECT id, CASE WHEN s LIKE '%partial%' THEN 'partial' WHEN s LIKE '%invalid%' THEN 'invalid' WHEN s LIKE '%valid%' THEN 'valid' ELSE 'error' END AS status, reason FROM (SELECT id, lower(trim(regexp_extract(replace(a, '~', chr(10)), '(?m)^STATUS:(.*)$', 1))) AS s, trim(regexp_extract(replace(a, '~', chr(10)), '(?m)^REASONING:(.*)$', 1)) AS reason FROM {JUDGED})"""


def _statuses(t: Tables) -> DataFrame:
    a = F.translate("a", "~", "\n")
    s = F.lower(F.regexp_extract(a, "(?m)^STATUS:(.*)$", 1))
    status = F.when(s.contains("partial"), "partial").when(s.contains("invalid"), "invalid").when(s.contains("valid"), "valid").otherwise("error")
    return t.cases(JUDGED).select("id", status.alias("status"), F.trim(F.regexp_extract(a, "(?m)^REASONING:(.*)$", 1)).alias("reason"))


@query(_STATUS)
def status_parse(t: Tables) -> DataFrame:
    return _statuses(t)


@query(f"WITH s AS ({_STATUS}) SELECT count(*) AS total, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'invalid') AS invalid, round(100.0 * count(*) FILTER (status = 'valid') / count(*), 6)::DOUBLE AS percent FROM s")
def validation_report(t: Tables) -> DataFrame:
    s = _statuses(t)
    return s.agg(F.count("*").alias("total"), count_if(F.col("status") == "valid").alias("valid"), count_if(F.col("status") == "invalid").alias("invalid"), F.round(100.0 * count_if(F.col("status") == "valid") / F.count("*"), 6).alias("percent"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("snippet"))


BLOCKS = Cases("""(0, 'Here: {"question": "Q one", "ground_truth": "A one"} done'), (1, '{"question": "Q two"}'), (2, 'no json at all'), (3, '{broken')""", "chunk, a", "SELECT 1000 + conv_id * 1000 + turn, 'Here: ' || chr(123) || '\"question\": \"' || role || '\"' || CASE WHEN turn % 3 = 0 THEN ', \"ground_truth\": \"' || CAST(conv_id AS STRING) || '\"' ELSE '' END || CASE WHEN turn % 5 = 4 THEN '' ELSE chr(125) END || ' done' FROM conversations")


@query(rf"""WITH b AS (SELECT chunk, nullif(regexp_extract(a, '(?s)\{{.*\}}', 0), '') AS j FROM {BLOCKS}), v AS (SELECT chunk, CASE WHEN json_valid(j) THEN j END AS j FROM b)
  SELECT chunk, coalesce(j::JSON->>'question', '') AS question, coalesce(j::JSON->>'ground_truth', '') AS truth, CASE WHEN chunk % 2 = 0 THEN 'fil' ELSE 'en' END AS lang FROM v""")
def json_block_parse(t: Tables) -> DataFrame:
    j = F.regexp_extract("a", r"(?s)\{.*\}", 0)
    field = lambda name: F.coalesce(F.get_json_object(j, f"$.{name}"), F.lit(""))
    return t.cases(BLOCKS).select("chunk", field("question").alias("question"), field("ground_truth").alias("truth"), F.when(F.col("chunk") % 2 == 0, "fil").otherwise("en").alias("lang"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def batch_summary(t: Tables) -> DataFrame:
    return t.documents.rollup("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


REFINED = Cases("(1, 'REFINED_ANSWER: better~more', 'orig'), (2, 'oops', 'orig'), (3, 'x~REFINED_QUESTION: why', 'orig')", "id, a, o", "SELECT 1000 + conv_id * 1000 + turn, CASE turn % 3 WHEN 0 THEN 'REFINED_ANSWER: ' || role WHEN 1 THEN role ELSE 'y~REFINED_QUESTION: why ' || role || '~z' END, 'own ' || role FROM conversations")


@query(f"SELECT id, coalesce(nullif(trim(regexp_extract(replace(a, '~', chr(10)), '(?m)^REFINED_[A-Z]+:(.*)$', 1)), ''), o) AS value, regexp_extract(replace(a, '~', chr(10)), '(?m)^REFINED_[A-Z]+:(.*)$', 1) <> '' AS changed FROM {REFINED}")
def refined_answer(t: Tables) -> DataFrame:
    found = F.regexp_extract(F.translate("a", "~", "\n"), "(?m)^REFINED_[A-Z]+:(.*)$", 1)
    return t.cases(REFINED).select("id", F.coalesce(F.nullif(F.trim(found), F.lit("")), "o").alias("value"), (found != "").alias("changed"))


@query("WITH t AS (SELECT event_id, value AS search, value / 2 AS rerank, value / 4 AS generation FROM events) SELECT event_id, CASE WHEN search + rerank + generation > 0 THEN round(100 * search / (search + rerank + generation), 6) ELSE 0.0 END AS search_percent, CASE WHEN search + rerank + generation > 0 THEN round(100 * generation / (search + rerank + generation), 6) ELSE 0.0 END AS generation_percent FROM t")
def timing_percent(t: Tables) -> DataFrame:
    v = F.col("value")
    total = v + v / 2 + v / 4
    share = lambda x: F.when(total > 0, F.round(100 * x / total, 6)).otherwise(0.0)
    return t.events.select("event_id", share(v).alias("search_percent"), share(v / 4).alias("generation_percent"))


@query("""WITH f AS (SELECT source, count(*) AS files, count(*) FILTER (n_chars >= 200) AS done FROM documents GROUP BY source)
  SELECT source, files, done, files - done AS failed, round(100.0 * done / files, 6)::DOUBLE AS success_rate, CASE WHEN done = files THEN 'success' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status FROM f""")
def ingestion_stats(t: Tables) -> DataFrame:
    f = t.documents.groupBy("source").agg(F.count("*").alias("files"), count_if(F.col("n_chars") >= 200).alias("done"))
    status = F.when(F.col("done") == F.col("files"), "success").when(F.col("done") > 0, "partial").otherwise("failed")
    return f.select("source", "files", "done", (F.col("files") - F.col("done")).alias("failed"), F.round(100.0 * F.col("done") / F.col("files"), 6).alias("success_rate"), status.alias("status"))


FORMATS = Cases("('.pdf', 'documents'), ('.txt', 'text'), ('.md', 'text'), ('.json', 'data')", "suffix, category", "SELECT DISTINCT '.' || lang, source FROM documents")


@query(f"SELECT category, list(suffix ORDER BY suffix) AS suffixes FROM {FORMATS} GROUP BY category")
def format_grouping(t: Tables) -> DataFrame:
    return t.cases(FORMATS).groupBy("category").agg(F.array_sort(F.collect_list("suffix")).alias("suffixes"))


ENTRIES = Cases("(1, ' Q? ', ' A ', 'c1', NULL), (2, 'What', 'B', NULL, array('x', 'y')), (3, '  ', 'C', NULL, NULL)", "id, q, a, c, cs", "SELECT 1000 + conv_id * 1000 + turn, CASE turn % 3 WHEN 0 THEN ' ' || split_part(text, '.', 1) || '? ' WHEN 1 THEN role ELSE '  ' END, ' ' || role || ' ', CASE WHEN turn % 2 = 0 THEN text END, CASE WHEN turn % 4 = 1 THEN split(text, ' ') END FROM conversations")


@query(f"""SELECT id, trim(q) AS question, trim(a) AS ground_truth, coalesce(c, array_to_string(cs, chr(10)), '') AS context, CASE WHEN trim(q) = '' THEN NULL WHEN trim(q) LIKE '%?' THEN trim(q) ELSE trim(q) || '?' END AS asked
  FROM {str(ENTRIES).replace("array('x', 'y')", "['x', 'y']")}""")
def reshape_entries(t: Tables) -> DataFrame:
    q = F.trim("q")
    asked = F.when(q == "", None).when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))
    return t.cases(ENTRIES).select("id", q.alias("question"), F.trim("a").alias("ground_truth"), F.coalesce("c", F.array_join("cs", "\n"), F.lit("")).alias("context"), asked.alias("asked"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, list_filter(json_keys(props), lambda x: x <> 'k') AS other FROM events""")
def field_drop(t: Tables) -> DataFrame:
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.filter(keys, lambda x: x != "k").alias("other"))


# ---- message trees and usage


@query("SELECT c.conv_id, c.turn, string_agg(a.turn::VARCHAR || ':' || a.role, '/' ORDER BY a.turn) AS path FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn <= c.turn GROUP BY c.conv_id, c.turn")
def subtree_path(t: Tables) -> DataFrame:
    return trees.paths(t.conversations.select("conv_id", "turn", "role"))


#: Conversations as trees that branch: the first turn is the root, and each turn k has the turns 2k + 1 and 2k + 2 below it.
_BRANCHES = "SELECT conv_id, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn || ':' || role AS label FROM conversations"


@query(f"""WITH RECURSIVE n AS ({_BRANCHES}), p AS (SELECT conv_id, id, 1::BIGINT AS depth, label AS path FROM n WHERE parent IS NULL
  UNION ALL SELECT n.conv_id, n.id, p.depth + 1, p.path || '/' || n.label FROM n JOIN p ON n.conv_id = p.conv_id AND n.parent = p.id) SELECT * FROM p""")
def branch_paths(t: Tables) -> DataFrame:
    turn = F.col("turn")
    nodes = t.conversations.select("conv_id", turn.alias("id"), F.when(turn > 0, F.floor((turn - 1) / 2)).cast("long").alias("parent"), F.concat(turn.cast("string"), F.lit(":"), "role").alias("label"))
    return trees.root_paths(nodes, ["conv_id"], "label")


@query("SELECT conv_id, turn, role, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ancestors, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS child FROM conversations")
def tree_convert(t: Tables) -> DataFrame:
    return trees.from_turns(t.conversations.select("conv_id", "turn", "role"))


@query("SELECT o_custkey, CASE WHEN n < 5 THEN '<5' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' ELSE '20+' END AS bucket FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def count_bucket(t: Tables) -> DataFrame:
    n = F.col("n")
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", F.when(n < 5, "<5").when(n < 10, "5-9").when(n < 20, "10-19").otherwise("20+").alias("bucket"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[-8:], ' ') AS tail FROM conversations")
def last_words(t: Tables) -> DataFrame:
    w = T.words_of(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.array_join(F.when(F.size(w) > 8, F.slice(w, -8, 8)).otherwise(w), " ").alias("tail"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def usage_rollup(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT date_trunc('month', ts) AS month, count(*) AS n, round(sum(value), 4) AS total, TRUE AS users_near, TRUE AS median_near FROM events GROUP BY 1")
def usage_months(t: Tables) -> DataFrame:
    """Months from the days' stored sketches; beside them, whether users and medians are within the sketches' error of exact ones."""
    folder = working_folder(t.spark)
    rollups.daily(t.events).write.parquet(folder)
    months = rollups.told(rollups.merged(t.spark.read.parquet(folder), "month"), 0.5)
    exact = t.events.groupBy(F.date_trunc("month", F.col("ts").cast("timestamp")).alias("day")).agg(F.countDistinct("user_id").alias("all_users"), F.percentile("value", F.array(F.lit(0.45), F.lit(0.55))).alias("around"))
    near = (F.abs(F.col("users") - F.col("all_users")) <= 0.08 * F.col("all_users") + 1).alias("users_near")
    middle = F.col("q50").between(F.col("around")[0], F.col("around")[1]).alias("median_near")
    return months.join(exact, "day").select(F.col("day").alias("month"), "n", F.round("total", 4).alias("total"), near, middle)
