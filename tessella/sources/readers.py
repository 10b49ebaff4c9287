"""Sources and sinks: files of several formats as one typed table, and what tells them apart.

PDF pages, remote titles and translations need models or libraries that are not here: they come as functions that a caller
passes in, with a fallback that needs nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD, decimals, strip, words_of

# What a path says about its source, in order, and the formats that loaders and checks know.
SOURCE_KINDS = ("100year", "bible", "google_books", "gutenberg", "news_sites", "wikipedia")
LOADERS = {".pdf": "pdf", ".txt": "text", ".json": "json"}
SUPPORTED = (".txt", ".md", ".pdf", ".docx", ".doc")
BOOK_KEYS = ("title", "author", "translatedBy", "yearPublished", "text")
NEWS_KEYS = ("text", "category", "date", "tags", "url")
ENCYCLOPEDIA_KEYS = ("date", "title", "text")

#: One schema for the three shapes of corpus records; a missing field is null.
RECORD = "title string, author string, translatedBy string, yearPublished string, text string, category string, date string, tags array<string>, url string"


def extension(path: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1), F.lit("")))


def source_kind(path: Column) -> Column:
    out = F.lit("unknown")
    for kind in reversed(SOURCE_KINDS):
        out = F.when(F.lower(path).contains(kind), kind).otherwise(out)
    return out


def loader(path: Column) -> Column:
    """By extension; other names with .txt in them are text; the rest is an error."""
    out = F.when(F.regexp_extract(path, "([^/]*)$", 1).contains(".txt"), "text").otherwise("error")
    for suffix, name in LOADERS.items():
        out = F.when(extension(path) == suffix, name).otherwise(out)
    return out


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED)


def record_shape(record: Column, kind: Column) -> Column:
    """Shape of a JSON record by the keys it has, null values included."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    has = lambda names: F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0
    return F.when(has(BOOK_KEYS), "books").when(has(NEWS_KEYS), "news").when(has(ENCYCLOPEDIA_KEYS), "encyclopedia").when(has(("text",)) & kind.isin("100year", "bible"), "text").otherwise("error")


def clean_title(c: Column, suffixes: tuple[str, ...], otherwise: str) -> Column:
    """A page's title without its publisher's suffixes."""
    for s in suffixes:
        c = F.replace(c, F.lit(s), F.lit(""))
    return F.coalesce(F.nullif(strip(F.regexp_replace(F.regexp_replace(c, "[ |]+$", ""), r"\s+", " ")), F.lit("")), F.lit(otherwise))


def delimited_questions(df: DataFrame, column: str, delimiter: str = "?") -> DataFrame:
    """df with a row for each part of the column between delimiters, as `question`, a question mark behind it."""
    parts = F.filter(F.transform(F.split(column, "\\Q" + delimiter + "\\E"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn("question", F.explode(parts)).withColumn("question", F.when(F.col("question").endswith("?"), F.col("question")).otherwise(F.concat("question", F.lit("?"))))


def search_tokens(c: Column) -> Column:
    """Sorted distinct words without accents and punctuation, lower-cased, and the whole text as one word."""
    plain = F.regexp_replace(strip_accents(F.lower(c)), f"[^{WORD}\\s]", "")
    whole = F.regexp_replace(plain, r"\s+", "")
    return F.array_sort(F.array_distinct(F.concat(words_of(plain), F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))))


# Latin letters with accents and the letters they are found under.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of a folder that some loader knows: (path, parent, name, extension, size, modified, content, hash, loader, kind)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return described(files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")).where("loader <> 'error'")


def described(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with what their paths and bytes say of them: parent, name, extension, hash, loader, kind."""
    path = F.col("path")
    return files.withColumns({"parent": F.regexp_extract(path, "([^/]*)/[^/]*$", 1), "name": F.regexp_extract(path, "([^/]*)$", 1), "extension": extension(path), "hash": F.sha2("content", 256), "loader": loader(path), "kind": source_kind(path)})


def subfolder_path(path: Column) -> Column:
    """The last six folders of a path, joined by dots."""
    folders = F.filter(F.split(path, "/"), lambda x: x != "")
    above = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0)))
    return F.array_join(F.slice(above, F.greatest(F.size(above) - 5, F.lit(1)), F.lit(6)), ".")


def page_texts(pages: DataFrame, least: int = 50) -> DataFrame:
    """pages (path, page, text, blocks): (path, page, text); a page with less text than `least` is read by blocks, blank ones go."""
    short = F.length(strip(F.coalesce("text", F.lit("")))) < least
    return pages.select("path", "page", F.when(short, F.coalesce("blocks", "text")).otherwise(F.col("text")).alias("text")).where(strip(F.coalesce("text", F.lit(""))) != "")


def choose_pages(files: DataFrame, primary: DataFrame, fallback: DataFrame | None = None, least: int = 50) -> DataFrame:
    """files (path), two readers' pages (path, page, text[, blocks]): (path, page, text, status).

    The first reader's pages count where one of them has more than `least` characters, else the second one's; a file that
    neither can read has one row with status error. Tasks keep the paths they ask for, pages pass by: they are not sorted.
    """
    good = lambda pages: pages.groupBy("path").agg(F.max(F.length(strip("text"))).alias("most")).where(F.col("most") > least).select("path")
    first = page_texts(primary, least)
    readable = good(first).hint("shuffle_hash")
    taken = first.join(readable, "path", "left_semi")
    if fallback is not None:
        other = fallback.select("path", "page", "text").where(strip(F.coalesce("text", F.lit(""))) != "")
        taken = taken.unionByName(other.join(readable, "path", "left_anti"))
    taken = taken.withColumn("status", F.lit("ok"))
    failed = files.select("path").join(taken.select("path").distinct().hint("shuffle_hash"), "path", "left_anti").select("path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), F.lit("error").alias("status"))
    return taken.withColumn("page", F.col("page").cast("int")).unionByName(failed)


def remote_title(fetched: Column, otherwise: str = "News Article") -> Column:
    """The title that a fetcher found, or the constant where it found none or there is no fetcher (a null column)."""
    return F.coalesce(F.nullif(strip(fetched), F.lit("")), F.lit(otherwise))


PagesReader = Callable[[DataFrame], DataFrame]


def read_documents(files: DataFrame, pdf_pages: PagesReader | None = None, pdf_fallback: PagesReader | None = None) -> DataFrame:
    """described() files as (path, subfolder_path, hash, kind, page, title, text, status): a row for each text file, JSON record or PDF page.

    JSON files hold a list of records; one that does not parse gives a row with status error and no text. pdf_pages turns
    (path, content) into (path, page, text, blocks), pdf_fallback what it cannot read into (path, page, text); without them PDF
    files give an error row.
    """
    base = ["path", "hash", "kind"]
    blank = {"page": F.lit(None).cast("int"), "title": F.lit(None).cast("string"), "status": F.lit("ok")}
    texts = files.where("loader = 'text'").select(*base, F.decode("content", "UTF-8").alias("text")).withColumns(blank)
    parsed = files.where("loader = 'json'").select(*base, F.from_json(F.decode("content", "UTF-8"), f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in RECORD.split(', '))}>>").alias("r"))
    records = parsed.select(*base, F.explode_outer("r").alias("r")).select(*base, F.coalesce("r.text", F.lit("")).alias("text"), F.lit(None).cast("int").alias("page"), F.col("r.title").alias("title"), F.when(F.col("r").isNull(), "error").otherwise("ok").alias("status"))
    pdf = files.where("loader = 'pdf'")
    if pdf_pages is None:
        pages = pdf.select(*base, F.lit(None).cast("string").alias("text")).withColumns(blank | {"status": F.lit("error")})
    else:
        given = pdf.select("path", "content")
        pages = choose_pages(given, pdf_pages(given), pdf_fallback and pdf_fallback(given)).join(pdf.select(*base), "path").withColumn("title", F.lit(None).cast("string"))
    columns = [*base, "page", "title", "text", "status"]
    every = texts.select(*columns).unionByName(records.select(*columns)).unionByName(pages.select(*columns))
    return every.withColumn("subfolder_path", subfolder_path(F.col("path")))


def whole_texts(files: DataFrame, pages: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """described() files as (path, text, status): a whole text a file, for generators of questions.

    Text files are read; PDF files are their pages (path, page, text) with a blank line between them; .docx and .doc files
    what a reader (path, text) found. Other formats, and files without a reader, have status error.
    """
    suffix = F.col("extension")
    plain = files.where(suffix == ".txt").select("path", F.decode("content", "UTF-8").alias("text"))
    if pages is not None:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
        plain = plain.unionByName(pages.join(files.where(suffix == ".pdf").select("path"), "path").groupBy("path").agg(joined.alias("text")))
    if words is not None:
        plain = plain.unionByName(words.join(files.where(suffix.isin(".docx", ".doc")).select("path"), "path").select("path", "text"))
    return files.select("path").join(plain, "path", "left").select("path", "text", F.when(F.col("text").isNull(), "error").otherwise("ok").alias("status"))


def store_rows(batches: DataFrame) -> DataFrame:
    """batches (batch_id, ids, documents, metadatas, embeddings: arrays): (batch_id, id, document, metadata, embedding, status), a row a document.

    A batch whose arrays differ in length is one row with status error; a missing id becomes doc_<place>_<hash of the text>.
    """
    n = F.size("documents")
    sound = (F.size("metadatas") == n) & (F.size("embeddings") == n) & (F.col("ids").isNull() | (F.size("ids") == n))
    rows = batches.where(sound).select("batch_id", "ids", F.posexplode(F.arrays_zip("documents", "metadatas", "embeddings")).alias("place", "r"))
    named = F.coalesce(F.get("ids", F.col("place")), F.concat(F.lit("doc_"), F.col("place").cast("string"), F.lit("_"), F.md5(F.col("r.documents").cast("binary"))))
    good = rows.select("batch_id", named.alias("id"), F.col("r.documents").alias("document"), F.col("r.metadatas").alias("metadata"), F.col("r.embeddings").alias("embedding"), F.lit("ok").alias("status"))
    bad = batches.where(~F.coalesce(sound, F.lit(False))).select("batch_id").withColumns({f.name: F.lit(None).cast(f.dataType) for f in good.schema if f.name in ("id", "document", "metadata", "embedding")}).withColumn("status", F.lit("error"))
    return good.unionByName(bad)


def clear_store(spark: SparkSession, folder: str) -> None:
    """Drops all rows and keeps the columns; a store needs no step to be persisted, it is when it is written."""
    kept = spark.read.parquet(folder).schema
    spark.createDataFrame([], kept).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)


def write_store(df: DataFrame, folder: str, mode: str = "append") -> None:
    """A vector store is a Parquet folder, partitioned by source kind so that filters skip files."""
    df.write.mode(mode).partitionBy("kind").parquet(folder) if "kind" in df.columns else df.write.mode(mode).parquet(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a struct `metadata` flattened to metadata_* columns and its lists joined by commas."""
    if "metadata" in df.columns:
        flat = [(F.array_join(f"metadata.{f.name}", ", ") if f.dataType.typeName() == "array" else F.col(f"metadata.{f.name}")).alias(f"metadata_{f.name}") for f in df.schema["metadata"].dataType.fields]
        df = df.select(*(c for c in df.columns if c != "metadata"), *flat)
    df.write.mode("overwrite").option("header", True).csv(folder)


def write_text(df: DataFrame, column: str, folder: str) -> None:
    """A report a row, each in the order of df's partitions."""
    df.select(column).write.mode("overwrite").text(folder)


# The layout of the reports on judged answers.
BAR, RULE, DASHES = "=" * 80, "\u2500" * 80, "-" * 80
EVALUATION = "\n{bar}\nEVALUATION %d/%d\n{bar}\n\nQUESTION:\n%s\n\nGOLDEN ANSWER:\n%s\n\nMODEL ANSWER:\n%s\n\n{rule}\nJUDGE EVALUATIONS:\n{rule}\n\n"
JUDGE = "Judge: %s%s\n  Overall Score:           %.2f/5\n  - Factual Accuracy:      %.2f/5\n  - Cultural Sensitivity:  %.2f/5\n  - Completeness:          %.2f/5\n  \n  Reasoning:\n%s\n\n"
OUTLIER = " [OUTLIER]"
STATISTICS = "{rule}\nSTATISTICAL SUMMARY:\n{rule}\nMean Score (all judges):     %.2f/5\nMedian Score:                %.2f/5\nStandard Deviation:          %.2f\n"
WITH_OUTLIERS = "Outliers Detected:           %s\nFinal Score (outliers removed): %.2f/5\n\n"
WITHOUT_OUTLIERS = "Outliers Detected:           None\nFinal Score:                 %.2f/5\n\n"
SUMMARY = "Total Evaluations: %d\n\nSCORE STATISTICS\n{dashes}\nMean Final Score:   %.2f/5\nMedian Final Score: %.2f/5\nStd Deviation:      %.2f\nMin Score:          %.2f/5\nMax Score:          %.2f/5\n\n"
DISTRIBUTION, SCORES_IN = "SCORE DISTRIBUTION\n{dashes}\n", "%-20s %3d (%5.1f%%)\n"
OUTLIERS, OUTLIERS_OF, NO_OUTLIERS = "\nOUTLIER STATISTICS\n{dashes}\n", "%-20s %3d outliers (%5.1f%%)\n", "No outliers detected\n"
AGREEMENT = "\nJUDGE AGREEMENT RATE\n{dashes}\nJudges agree (within 1 point): %.1f%%\n"
#: Ranges of final scores: their names and upper ends.
SCORE_RANGES = (("0-3 (Poor)", 3), ("3-5 (Fair)", 5), ("5-7 (Good)", 7), ("7-9 (Very Good)", 9), ("9-10 (Excellent)", None))
QUALITY = (
    "{bar}\nQ&A SYSTEM EDUCATIONAL SUITABILITY (SEMANTIC EVALUATION)\n{bar}\nTotal Questions Evaluated: %d\n\n{rule}\nSEMANTIC ACCURACY (BERTScore)\n{rule}\nAverage BERTScore:       %.4f\n(Legacy Lexical F1):     %.4f\n\n"
    "Semantic Quality Distribution:\n  Excellent (>0.93):     %.2f%% (%d)\n  Good (>0.90):          %.2f%% (%d)\n  Acceptable (>0.70):    %.2f%% (%d)\n  Poor (<=0.70):         %.2f%% (%d)\n\nOverall Semantic Pass Rate: %.2f%%\n\n"
    "{rule}\nRELIABILITY (Grounding)\n{rule}\nGrounding Rate:          %.2f%%\nContext Availability:    %.2f%%"
)


def _filled(layout: str, *values) -> Column:
    """The layout with its values; numbers with decimals are rounded as printf does."""
    kinds = [(int(places or 0), kind) for places, kind in re.findall(r"%-?[0-9]*(?:\.([0-9]))?([dsf])", layout.replace("%%", ""))]
    shown = [decimals(F.col(v) if isinstance(v, str) else v, places) if kind == "f" else v for v, (places, kind) in zip(values, kinds, strict=True)]
    return F.format_string(re.sub(r"(%-?[0-9]*)\.[0-9]f", r"\1s", layout).format(bar=BAR, rule=RULE, dashes=DASHES), *shown)


def _headed(title: str) -> str:
    return f"{BAR}\n{title}\n{BAR}\n\n"


def judge_report(results: DataFrame, title: str) -> DataFrame:
    """results (number, total, question, gold, answer, judges, mean, median, deviation, final): (number, report); the first has the title.

    judges: array of (judge, overall, accuracy, sensitivity, completeness, reasoning, outlier).
    """

    def judged(j: Column) -> Column:
        reasons = F.array_join(F.transform(F.split(j["reasoning"], "\n"), lambda line: F.concat(F.lit("  "), line)), "\n")
        return _filled(JUDGE, j["judge"], F.when(j["outlier"], OUTLIER).otherwise(""), j["overall"], j["accuracy"], j["sensitivity"], j["completeness"], reasons)

    outliers = F.transform(F.filter("judges", lambda j: j["outlier"]), lambda j: j["judge"])
    last = F.when(F.size(outliers) > 0, _filled(WITH_OUTLIERS, F.array_join(outliers, ", "), "final")).otherwise(_filled(WITHOUT_OUTLIERS, "final"))
    report = F.concat(_filled(EVALUATION, "number", "total", "question", "gold", "answer"), F.array_join(F.transform("judges", judged), ""), _filled(STATISTICS, "mean", "median", "deviation"), last)
    return results.select("number", F.concat(F.when(F.col("number") == 1, _headed(title)).otherwise(""), report).alias("report"))


def summary_of(results: DataFrame) -> DataFrame:
    """results as judge_report() takes them: one row of what summary_report() tells; the judges are few, the results many."""
    final = F.col("final")
    lowest = [F.lit(True), *(final >= end for _, end in SCORE_RANGES[:-1])]
    in_range = [F.sum((low & (final < end if end else final <= 10)).cast("long")) for low, (_, end) in zip(lowest, SCORE_RANGES)]
    overall = F.transform("judges", lambda j: j["overall"])
    several = F.size("judges") >= 2
    agree = F.coalesce(F.avg(F.when(several, (F.array_max(overall) - F.array_min(overall) <= 1.0).cast("double"))), F.lit(0.0))
    distribution = F.array(*(F.struct(F.lit(name).alias("name"), n.alias("n")) for (name, _), n in zip(SCORE_RANGES, in_range)))
    total = results.agg(F.count("*").alias("total"), F.avg(final).alias("mean"), F.median(final).alias("median"), F.stddev_pop(final).alias("deviation"), F.min(final).alias("least"), F.max(final).alias("most"), agree.alias("agreement"), distribution.alias("distribution"))
    of_judge = results.select(F.explode(F.filter("judges", lambda j: j["outlier"])).alias("j")).groupBy(F.col("j.judge").alias("name")).agg(F.count("*").alias("n"))
    return total.crossJoin(of_judge.agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("outliers")))


def summary_report(summary: DataFrame, title: str) -> DataFrame:
    """summary_of()'s row: (report), over all evaluations."""
    lines = lambda layout, column: F.array_join(F.transform(column, lambda x: _filled(layout, x["name"], x["n"], x["n"] * 100 / F.col("total"))), "")
    body = _filled(SUMMARY, "total", "mean", "median", "deviation", "least", "most")
    blocks = (F.lit(DISTRIBUTION.format(dashes=DASHES)), lines(SCORES_IN, "distribution"), F.lit(OUTLIERS.format(dashes=DASHES)), F.when(F.size("outliers") > 0, lines(OUTLIERS_OF, "outliers")).otherwise(NO_OUTLIERS))
    return summary.select(F.concat(F.lit(_headed(title)), body, *blocks, _filled(AGREEMENT, F.col("agreement") * 100)).alias("report"))


def quality_report(metrics: DataFrame) -> DataFrame:
    """The row of scores.system_metrics(): (report). Means of nothing count as 0."""
    percent = lambda c: F.col(c) * 100
    levels = [x for level in ("excellent", "good", "acceptable") for x in (percent(f"{level}_rate"), F.col(f"{level}_answers"))]
    poor = F.when(F.col("total_questions") > 0, F.col("poor_answers") * 100 / F.col("total_questions")).otherwise(0.0)
    means = [F.coalesce(c, F.lit(0.0)) for c in ("avg_semantic_score", "avg_f1_score")]
    layout = QUALITY.format(bar="=" * 70, rule="-" * 70)
    return metrics.select(_filled(layout, "total_questions", *means, *levels, poor, "poor_answers", percent("overall_quality_rate"), percent("grounding_rate"), percent("context_availability_rate")).alias("report"))
