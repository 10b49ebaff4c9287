"""The sequential operators against plain versions and worked cases; readers, sinks, trees and streams."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql.functions import lit

from tessella.functions import questions, text
from tessella.operators import prepare, search, trees
from tessella.plans import pipelines, registry
from tessella.sources import readers
from tessella.streaming import ingest


def test_collapse():
    assert prepare.collapse("a a a b") == "a b"
    assert prepare.collapse("x y x y z x y z x y") == "x y z x y"
    assert prepare.collapse("one two three four one two three four five") == "one two three four five"
    assert prepare.collapse("") == ""


def test_collapse_leaves_no_repeat_of_its_first_pass():
    r = random.Random(1)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(r.randrange(12))]
        out = prepare.collapse(" ".join(words)).split()
        assert set(out) == set(words) and len(out) <= len(words)


def test_bounds_never_change_the_answer():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randrange(1, 30))) for _ in range(2))
        assert prepare.at_least(a, b, 0.6) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.6)


def test_split_keeps_to_its_contract():
    r = random.Random(3)
    for _ in range(50):
        t = "".join(r.choice([f"w{n} ", " ", ". ", "! ", "\n", "\n\n", f"{n:040d}", f"é{n}"]) for n in range(200))
        pieces = prepare.split_text(t, 100, 40)
        assert all(0 < len(p) <= 100 and p == p.strip() for p in pieces)
        assert all(p in t for p in pieces)
        assert all(any(w in f"{p} " for p in pieces) for w in re.findall(r"w[0-9]+ ", t))


def test_small_pieces_join():
    assert prepare.merge_small(["a" * 10], 256) == ["a" * 10]
    assert [len(p) for p in prepare.merge_small(["a" * 100] * 5, 256)] == [302, 201]


def context_rows(spark, given):
    full = [(1, i, *row) for i, row in enumerate(given)]
    return spark.createDataFrame(full, "query_id long, seq long, content string, final_score double, source_file string, page int, title string, date string, url string")


def test_prepared_contexts(spark):
    blank = (None, None, None, None, None)
    given = [("Rice is a staple food of the islands.", 0.6, *blank), ("Rice is a staple food of the islands.", 0.9, *blank), ("  ", 0.9, *blank), ("Boats sail at dawn , mostly", 0.7, "data/sea-trade.pdf", 3, None, None, None), ("go go go on", 0.1, *blank)]
    out = [(r["text"], r["final_score"], r["citation_text"]) for r in prepare.prepare_contexts(context_rows(spark, given)).orderBy("rank").collect()]
    assert out == [("Rice is a staple food of the islands.", 0.9, None), ("Boats sail at dawn, mostly", 0.7, "Sea Trade, p. 3"), ("go on", 0.1, None)]


def test_answers_read_whole_contents(spark):
    r = random.Random(8)
    words = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    opening = words("abcdefgh", 100)
    texts = [f"{opening} {words('ijklmnop', 400)} the answer is 42", f"{opening} {words('qrstuvwx', 400)} the end"]
    found = spark.createDataFrame([(1, i, t, 0.9 - i / 10, i + 1) for i, t in enumerate(texts)], "query_id long, doc_id long, content string, score double, rank int")
    row = pipelines.answer(found, spark.createDataFrame([(1, "What is it?")], "query_id long, query string")).first()
    assert row["contexts"] == texts and row["answer"] == texts[0]


def test_batches_ask_every_benchmark_row(spark):
    folder = "/root/testdata/sf0.001"
    items = {r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id").collect()}
    asked = registry.queries()["answer_batch"](spark, folder)
    assert {r["query_id"] for r in asked.select("query_id").collect()} == items and len(items) > 20
    assert registry.queries()["evaluate_batch"](spark, folder).first()["items"] == len(items)


def test_diversity_is_asked_of_every_twentieth_vector(spark):
    folder = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r["query_id"] for r in registry.queries()["mmr_select"](spark, folder).collect()} == ids


def test_contexts_are_whole_search_results(spark):
    folder = "/root/testdata/sf0.001"
    items = {r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id").collect()}
    out = registry.queries()["context_prepare"](spark, folder).collect()
    assert {r["query_id"] for r in out} == items and max(len(r["text"]) for r in out) > 400


def test_same_context():
    assert not prepare.same_context("short", "a much longer text than the first")
    assert prepare.same_context("this text has well over thirty characters", "this text has well over thirty characters, and some more")


def test_preprocess_window(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(1, "f", base), (2, "f", base), (3, "f", base + " now"), (4, "g", base), (5, "f", "too short")]
    out = {r["doc_id"]: r["status"] for r in prepare.preprocess(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert out == {1: "kept", 2: "exact", 3: "near", 4: "kept", 5: "invalid"}


def test_mmr_without_diversity_is_the_top(spark):
    r = random.Random(5)
    q = [1.0, 0.0, 0.0]
    rows = [(1, i, i, [r.random(), r.random(), r.random()], q) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, seq long, doc_id long, embedding array<double>, query_vector array<double>")
    got = [x["doc_id"] for x in search.mmr(df, 5, 1.0, 0.0).orderBy("rank").collect()]
    cos = lambda v: v[0] / sum(c * c for c in v) ** 0.5
    assert got == [x[2] for x in sorted(rows, key=lambda x: (-round(cos(x[3]), 9), x[1]))[:5]]
    assert search.mmr(df, 5, 0.5, 1.1).count() == 0


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    v = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(40)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(9)], "query_id long, query_vector array<double>")
    whole = sorted(map(tuple, search.nearest(v, q).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 7)
    assert sorted(map(tuple, search.nearest(v, q).collect())) == whole
    for limit in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert sorted(map(tuple, search.nearest(v, q).collect())) == whole


def test_vectors_of_blank_texts_are_left_out(spark):
    some = [(i, [float(i), 1.0]) for i in range(6)]
    v, q = (spark.createDataFrame(some, f"{names} array<double>") for names in ("vec_id long, embedding", "query_id long, query_vector"))
    want = sorted(map(tuple, search.nearest(v, q, threshold=None).collect()))
    v, q = (x.union(spark.createDataFrame([(7, []), (8, None)], x.schema)).coalesce(1) for x in (v, q))
    assert sorted(map(tuple, search.nearest(v, q, threshold=None).collect())) == want


def test_retrieval_with_blank_and_missing_rows(spark, tmp_path):
    for table, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        df = spark.read.parquet(f"{SMALL}/{table}.parquet")
        odd = [df.limit(1).withColumns({key: lit(i).cast("long"), "text": lit(x).cast("string")}) for i, x in ((100_000, ""), (200_000, " "), (300_000, None))]
        for x in [*odd, df.limit(1).withColumn(key, lit(None).cast("long"))]:
            df = df.unionByName(x)
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{table}.parquet")
    found = registry.queries()["retrieve_variants"](spark, f"file://{tmp_path}").collect()
    assert {0, 20} <= {r["query_id"] for r in found} and not {r["query_id"] for r in found} & {100_000, 200_000, 300_000}
    assert all(r["doc_id"] < 100_000 for r in found)


def test_fusion_does_not_depend_on_the_lists_order(spark):
    lists = [(0, l, k, d) for l, ds in enumerate(["ABC", "BDA"]) for k, d in enumerate(ds)]
    swapped = [(0, 1 - l, k, d) for _, l, k, d in lists]
    columns = "query_id long, list_idx long, rank long, doc_id string"
    score = lambda x: {r["doc_id"]: r["score"] for r in search.reciprocal_rank(spark.createDataFrame(x, columns)).collect()}
    assert score(lists) == score(swapped)
    assert max(score(lists), key=score(lists).get) == "B"


@pytest.mark.parametrize("q,kind", [("Bakit mahalaga ang wika?", "Analytical"), ("How to cook rice", "Procedural"), ("Compare A versus B", "Comparative"), ("Tell me about festivals", "Exploratory"), ("", "Factual")])
def test_question_types(spark, q, kind):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(q,)], "q string")
    assert df.select(questions.question_type(F.col("q"))[0].alias("k")).first()["k"] == kind


def test_normalising_nulls_and_blanks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, " \n "), (3, "12 helloWorld ,ofthings  ok!!")], "i int, t string")
    out = {r["i"]: r["n"] for r in df.select("i", text.normalize(F.col("t")).alias("n")).collect()}
    assert out == {1: "", 2: "", 3: "hello World, of things ok!"}


def test_scan_read_and_sinks(spark, tmp_path):
    (tmp_path / "in/news_sites").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("plain text")
    (tmp_path / "in/skip.bin").write_bytes(b"x")
    (tmp_path / "in/news_sites/b.json").write_text(json.dumps([{"title": "T", "text": "one", "tags": ["x", "y"]}, {"text": None}]))
    (tmp_path / "in/c.json").write_text("{broken")
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF")
    files = readers.scan(spark, str(tmp_path / "in"))
    assert files.count() == 4
    out = readers.read_documents(files)
    assert sorted((r["status"], r["text"] or "") for r in out.collect()) == [("error", ""), ("error", ""), ("ok", ""), ("ok", "one"), ("ok", "plain text")]
    readers.write_store(out, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("kind = 'news_sites'").count() == 2
    nested = spark.sql("SELECT 1 AS id, named_struct('tags', array('x', 'y'), 'lang', 'en') AS metadata")
    readers.write_csv(nested, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"id": "1", "metadata_tags": "x, y", "metadata_lang": "en"}
    readers.write_json(nested, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_trees(spark):
    from pyspark.sql import functions as F

    tree = spark.sql("SELECT 'r' AS id, cast(array() AS array<string>) AS ancestors, 'x' AS content")
    tree = trees.add_sibling(trees.add_child(tree, F.lit("r"), "a", "y"), F.lit("a"), "b", "z")
    assert {r["id"]: r["ancestors"] for r in tree.collect()} == {"r": [], "a": ["r"], "b": ["r"]}
    assert trees.subtree(tree, "r").count() == 3 and trees.subtree(tree, "a").count() == 1


def test_incremental_ingestion(spark, tmp_path):
    long = "a text that is long enough to count as valid, number "
    schema = "doc_id long, text string"
    folder, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    frame = lambda rows: spark.createDataFrame(rows, schema)
    frame([(1, long + "one."), (2, long + "one."), (3, "short")]).coalesce(1).write.parquet(folder)
    run = lambda: ingest.ingest_stream(spark, folder, spark.createDataFrame([], schema).schema, store, checkpoint).awaitTermination()
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(store).collect()) == [1]
    frame([(4, long + "one."), (5, long + "two.")]).coalesce(1).write.mode("append").parquet(folder)
    run()
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(store).collect()) == [1, 5]


def test_usage_windows(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1 AS user_id UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2")
    assert [(r["n"], r["users"]) for r in ingest.usage_windows(events).collect()] == [(2, 2)]


def plain_normalize(t):
    """The steps of normalising one after the other, with Python's own regular expressions."""
    blanks = " \t\n\x0b\f\r"

    def steps(t, rules):
        for pattern, to in rules:
            to = to.replace("$1", r"\1").replace("$2", r"\2")
            t = re.sub(pattern.replace("@", r"\b"), to, t, flags=0 if "@" in pattern else re.ASCII)
        return t

    t = t or ""
    return steps(steps(t, text.GLUED).strip(blanks), text.TIDY).strip(blanks) if t.strip(blanks) else ""


def test_normalize_by_plain_steps(spark):
    from pyspark.sql import functions as F

    r = random.Random(12)
    pieces = ["of", "ofthings", "into", "intothewild", "tionary", "helloWorld", "a1b2", ".", "..", ",x", "?!", "??", " ", "\n", "\t ", "12 ", "é", "Éof", "theend", "nessie", "x:y;z", "\x07", "ABcD", "3rd", "onofftheroad"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    once, twice = text.normalize(F.col("t")), text.normalize(text.normalize(F.col("t")))
    for row in df.select("i", once.alias("once"), twice.alias("twice")).collect():
        want = plain_normalize(texts[row["i"]])
        assert (row["once"], row["twice"]) == (want, plain_normalize(want)), texts[row["i"]]


def test_preprocess_by_a_plain_walk(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", F.substring("text", 1, 400).alias("text"))
    rows = sorted(tuple(x) for x in docs.collect())
    r = random.Random(13)
    rows += [(100_000 + k, s, " ".join(w for w in t.split() if r.random() > 0.05)) for k, (_, s, t) in enumerate(rows) if k % 2]
    want, kept = {}, {}
    word = re.compile(r"[^\w\s]")
    for i, source, t in sorted(rows):
        clean = plain_normalize(plain_normalize(t))
        seen = kept.setdefault(source, [])
        if len(clean.strip()) < 50 or len(word.sub("", clean).strip()) < 35:
            want[i] = "invalid"
        elif clean in (c for c, _ in seen):
            want[i] = "exact"
        else:
            form = plain_normalize(clean).lower()
            near = any(difflib.SequenceMatcher(None, form, other).ratio() >= 0.85 for _, other in seen[-10:])
            want[i] = "near" if near else "kept"
            if not near:
                seen.append((clean, form))
    got = {x["doc_id"]: x["status"] for x in prepare.preprocess(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == want and {"near", "kept"} <= set(want.values())


def test_numbers_follow_the_order_over_ranges(spark):
    r = random.Random(14)
    values = r.sample(range(10**6), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert [(x["v"], x["i"]) for x in prepare.numbered(df, "v").orderBy("i").collect()] == [(v, k + 1) for k, v in enumerate(sorted(values))]
    assert prepare.numbered(df.limit(0), "v").count() == 0


def test_variants_of_a_query(spark):
    from pyspark.sql import functions as F

    queries = spark.createDataFrame([(1, "short one"), (2, "compare the red boats and the blue boats, what are they for?")], "query_id long, query string")
    memo = spark.createDataFrame([("short one", "translated"), ("compare the red boats and the blue boats, what are they for?", "compare the red boats and the blue boats, what are they for?")], "query string, translated string")
    rows = pipelines.variants_of(queries, lambda c: F.array(F.length(c).cast("double")), memo, lambda q: F.lit("1. What are red boats for?\n2. What are blue boats for?")).collect()
    got = sorted((x["query_id"], x["list_idx"], x["query"], x["weight"]) for x in rows)
    assert got == [(1, 0, "short one", 1.0), (1, 1, "translated", 0.8), (2, 0, memo.collect()[1][0], 1.0), (2, 2, "What are red boats for?", 0.5), (2, 3, "What are blue boats for?", 0.5)]
    assert all(x["query_vector"] == [float(len(x["query"]))] for x in rows)


def test_diversity_without_vectors_and_of_single_results(spark):
    schema = "query_id long, seq long, doc_id long, embedding array<double>, query_vector array<double>"
    rows = [(1, k, 10 + k, [1.0, float(k)], None) for k in range(4)] + [(2, 0, 20, [0.0, 1.0], [1.0, 0.0])] + [(3, k, 30 + k, None if k == 0 else [1.0, 0.1 * k], [1.0, 0.0]) for k in range(3)]
    df = spark.createDataFrame(rows, schema)
    pick = lambda **s: sorted((x["query_id"], x["rank"], x["doc_id"]) for x in search.mmr(df, 2, **s).collect())
    assert pick(leave_single=True) == [(1, 1, 10), (1, 2, 11), (2, 1, 20), (3, 1, 31), (3, 2, 32)]
    assert pick() == [(1, 1, 10), (1, 2, 11), (3, 1, 31), (3, 2, 32)]


def test_stores_chunk_strategies_and_fields(spark, tmp_path):
    from tessella.operators import scores

    folder = str(tmp_path / "store")
    readers.write_store(spark.sql("SELECT 1 AS id, 'k' AS kind"), folder)
    readers.clear_store(spark, folder)
    assert spark.read.parquet(folder).count() == 0 and set(spark.read.parquet(folder).columns) == {"id", "kind"}
    docs = spark.createDataFrame([(1, "word " * 300), (2, None)], "doc_id long, text string")
    want = sorted(map(tuple, prepare.chunks(docs).collect()))
    with pytest.warns(UserWarning):
        assert sorted(map(tuple, prepare.chunked(docs, "smart").collect())) == want and len(want) > 2
    with pytest.raises(ValueError):
        prepare.chunked(docs, "unheard of")
    lists = spark.sql("SELECT array(named_struct('a', 1, 'b', 2)) AS s, 1 AS c")
    assert scores.without_field(lists, "s", "b").first()["s"][0].asDict() == {"a": 1}
    assert scores.without_field(lists, "s", "x").schema == lists.schema


def test_diversity_is_the_greedy_walk(spark):
    """mmr() against a walk in plain Python: queries with ties, copies, missing and zero vectors."""
    import math

    r = random.Random(12)
    vector = lambda: [float(r.randrange(-3, 4)) for _ in range(4)]
    rows = []
    for q in range(30):
        asked = vector() if q % 7 else None
        pool = [vector() for _ in range(5)] + [None, [0.0] * 4]
        rows += [(q, k, 100 * q + k, r.choice(pool), asked) for k in range(r.randrange(1, 15))]
    table = spark.createDataFrame(rows, "query_id long, seq long, doc_id long, embedding array<double>, query_vector array<double>")

    def cos(a, b):
        if a is None or b is None:
            return 0.0
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for bias, threshold in ((0.5, 0.1), (0.8, -1.0), (0.0, 0.3)):
        want = set()
        for q in range(30):
            mine = [x for x in rows if x[0] == q]
            if mine[0][4] is None:
                want |= {(q, x[2], k + 1) for k, x in enumerate(mine[:5])}
                continue
            left, chosen = [x for x in mine if cos(x[3], x[4]) >= threshold - 1e-12], []
            while left and len(chosen) < 5:
                gain = [round(cos(x[3], x[4]) if not chosen else bias * cos(x[3], x[4]) - (1 - bias) * max(cos(x[3], y[3]) for y in chosen), 9) for x in left]
                chosen.append(left.pop(gain.index(max(gain))))
            want |= {(q, x[2], k + 1) for k, x in enumerate(chosen)}
        assert {(x["query_id"], x["doc_id"], x["rank"]) for x in search.mmr(table, 5, bias, threshold).collect()} == want


def test_dates_of_years_above_9999_have_no_sign(spark):
    given = spark.createDataFrame([("253402736000000",), ("1704067200",), ("2024-06-15",)], "d string")
    assert [r[0] for r in given.select(text.long_date(given.d)).collect()] == ["January 06, 10000", "January 01, 2024", "June 15, 2024"]


def test_dates_that_are_known_to_be_seconds(spark):
    given = spark.sql("SELECT 'wikipedia/a.json' AS source, 'T' AS title, CAST(NULL AS INT) AS page, '10086249600' AS date, '' AS url")
    cited = lambda **how: given.select(text.citation(given.source, given.title, given.page, given.date, given.url, **how)).first()[0]
    assert cited(milliseconds=False) == "T (Wikipedia, accessed August 15, 2289)"
    assert cited() == "T (Wikipedia, accessed April 27, 1970)"


def test_numbers_are_rounded_as_printf_does(spark):
    given = spark.createDataFrame([(50,), (150,), (3000,)], "n long")
    assert [r[0] for r in given.select(text.processing_time(given.n, lit(253.0))).collect()] == ["12.7 seconds", "38.0 seconds", "12.7 minutes"]
    values = [6.25, 0.125, 2.675, 12.65, 1234567.0, -0.75]
    given = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (1, 2):
        assert [r[0] for r in given.select(text.decimals(given.v, places)).collect()] == [f"{v:.{places}f}" for v in values]
    assert given.select(readers._filled("%5.1f%% %d", given.v, lit(3))).first()[0] == "  6.2% 3"


def test_alignment_holds_one_row_of_a_batch_as_python_objects():
    import tracemalloc

    import pyarrow as pa

    from tessella.operators import scores

    kind = pa.list_(pa.struct([("side", pa.int32()), ("token", pa.string()), ("n", pa.int64()), ("idf", pa.float64())]))
    row = [{"side": i % 2, "token": f"w{i}", "n": 1, "idf": 1.0} for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([row, None, []] + [row] * 3997, kind)], names=["k", "sides"])
    del row
    tracemalloc.start()
    (out,) = scores._aligned(scores.spelling_embedder, 1)(iter([batch.slice(1)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 3999 and out.column("f1").to_pylist()[:2] == [1.0, 1.0] and out.column("k").to_pylist()[0] == 1
    assert peak < 16 << 20  # 91 MB where a batch became dictionaries


def test_normalize_takes_white_space_as_the_sql_does(spark):
    import duckdb
    from pyspark.sql import functions as F

    odd = ["a\x0bb", "\x0b word\x0b\x0b ", " a \t\n b", "\r", None, "intowner information", "x" * 3 + " y"] * 60
    got = spark.createDataFrame(list(enumerate(odd)), "i int, text string").select("i", text.normalize(F.col("text")).alias("n")).orderBy("i").collect()
    con = duckdb.connect()
    want = [con.execute(f"SELECT {text.normalize_sql('text')} FROM (SELECT ?::VARCHAR AS text)", [t]).fetchone()[0] for t in odd[:7]]
    assert [r["n"] for r in got] == want * 60


def test_blocks_of_vectors_of_different_widths_are_refused():
    import pyarrow as pa

    vectors = pa.list_(pa.list_(pa.float64()))
    of = lambda ids, rows: (pa.array([ids]), pa.array([rows], vectors))
    run = search._best_of_blocks("ip", 1, [pa.int64(), pa.int64(), pa.float64()])
    names = ["ids", "vectors", "asked", "query_vectors"]
    (out,) = run(iter([pa.RecordBatch.from_arrays([*of([7, 3], [[1.0, 2.0], [1.0, 2.0]]), *of([1], [[1.0, 1.0]])], names=names)]))
    assert out.to_pylist() == [{"query_id": 1, "vec_id": 3, "score": 3.0}]
    with pytest.raises(ValueError, match="widths"):
        list(run(iter([pa.RecordBatch.from_arrays([*of([7, 3], [[1.0, 2.0, 3.0], [1.0]]), *of([1], [[1.0, 1.0]])], names=names)])))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


SMALL = "/root/testdata/sf0.001"


def test_a_batch_searches_once_for_all_that_is_made_of_its_results(spark):
    for name in ("retrieve_batch", "retrieve_variants"):
        plan = plan_of(registry.queries()[name](spark, SMALL))
        assert not re.search("MapInArrow|FlatMapCoGroups|documents.parquet", plan), name  # neither search nor texts: its results are kept


def test_variants_are_sought_for_all_benchmark_rows_and_whole_texts(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(pipelines, "retrieve", lambda docs, vectors, queries, variants, **_: given.update(queries=queries, variants=variants) or docs.withColumn("content", docs["text"]))
    registry.queries()["retrieve_variants"](spark, SMALL)
    texts = dict(map(tuple, spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()))
    assert dict(map(tuple, given["queries"].select("query_id", "query").collect())) == texts
    variants = {(r["query_id"], r["list_idx"]): r["query"] for r in given["variants"].select("query_id", "list_idx", "query").collect()}
    assert all(variants[i, 0] == x and variants[i, 1] == x.upper() for i, x in texts.items())
    long = {i for i, x in texts.items() if len(x.split()) > 20}  # a question's whole length tells whether it has parts
    assert long and long <= {i for i, at in variants if at >= 2}


def test_near_texts_as_the_whole_ratio_says(monkeypatch):
    r = random.Random(23)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzÄß", k=r.randint(1, 9))) for _ in range(60)]
    texts = ["", "A", "a"]
    for size in (3, 12, 40, 120):  # below and above the 200 characters from which SequenceMatcher passes over common ones
        for _ in range(4):
            t = r.choices(words, k=size)
            texts += [" ".join(t), " ".join(w for w in t if r.random() > 0.1), " ".join(t[size // 3 :] + t[: size // 3]), " ".join(t).upper()]
    for threshold in (0.0, 0.5, 0.7, 0.85, 1.0):
        said = [(prepare.near(prepare.Compared(a), prepare.Compared(b), threshold), prepare.ratio(a, b) >= threshold) for a in texts[:40] for b in texts[:40]]
        assert all(x == y for x, y in said) and len({x for x, _ in said}) == (1 if threshold == 0 else 2)
    made = []
    monkeypatch.setattr(prepare, "SequenceMatcher", lambda *a: made.append(a) or difflib.SequenceMatcher(*a))
    one, others = prepare.Compared("abc " * 50), [prepare.Compared("abd " * 50), prepare.Compared("cba " * 50)]
    for other in others:
        prepare.near(other, one, 0.5)
    assert len(made) == 1  # a text's places are sought once, however many it is compared with


def test_ingestion_normalises_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ready = ingest.prepared(docs)
    assert "ArrowEvalPython" not in plan_of(ready) and set(ready.columns) == {*docs.columns, "content_hash"}


def test_pages_are_chosen_without_sorting_them(spark):
    plan = plan_of(registry.queries()["pdf_page_choice"](spark, SMALL))
    assert "Sort" not in plan and plan.count("ShuffledHashJoin") >= 3


def test_candidates_are_sought_for_the_questions_only(spark, monkeypatch):
    asked, nearest = [], search.nearest
    monkeypatch.setattr(search, "nearest", lambda v, q, *a, **b: asked.append({r[0] for r in q.select("query_id").collect()}) or nearest(v, q, *a, **b))
    found = {r["query_id"] for r in registry.queries()["bm25_candidates"](spark, SMALL).collect()}
    questions = {r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").where("item_id % 20 = 0").select("item_id").collect()}
    every = {r[0] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert found == questions & every and asked == [questions & every]


def test_what_was_found_goes_to_the_texts(spark):
    for name in ("prompt_build", "rerank_fallback", "context_prepare"):
        plan = plan_of(registry.queries()[name](spark, SMALL))
        assert plan.count("BroadcastHashJoin") and "SortMergeJoin" not in plan and "FlatMapCoGroups" not in plan, name


def test_strategies_that_fall_back_to_one_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "One sentence here. " * 60), (2, "")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="semantic"):
        out = prepare.chunked_by_each(docs, ["recursive", "semantic"])
    assert plan_of(out).count("MapInArrow") == 1
    want = sorted(tuple(x) for x in prepare.chunks(docs).collect())
    for strategy in ("recursive", "semantic"):
        assert sorted(tuple(x) for x in out.where(f"strategy = '{strategy}'").drop("strategy").collect()) == want
    with pytest.raises(ValueError):
        prepare.chunked_by_each(docs, ["none such"])
