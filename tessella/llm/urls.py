"""Operator 1, URL filters: a curated rule list, and association rules mined from what it labels.

A curated rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's; the longest wins.
Its verdicts are the labels: every URL that a rule fits becomes a transaction of its tokens and its verdict, and Spark's
FP-growth mines which token combinations go with a verdict. A combination must occur with it in MIN_SUPPORT of the labelled
URLs, and in LEAST of them whatever their number. FP-growth lists all parts of what is frequent, 2 ** n of n tokens, so the
frequent tokens of a URL that has more than MOST_TOKENS * GROUP are cut into groups of GROUP, and every MOST_TOKENS of these are
a transaction: any combination of up to MOST_TOKENS tokens lies in one at least. So none that is frequent is missed; some are
counted too often, which does not matter: support and confidence of every combination found are counted again on all tokens of
all labelled URLs. Tokens that always stand together, as the parts of one long path, are mined as one of them; each rule that
is left is told for all of them. Rules at MIN_CONFIDENCE are kept of which no part says the same with as much confidence.

URLs that no curated rule fits are judged by these. The rules lie in an inverted index under their rarest token; a URL's
tokens look up the rules that could apply, and those of which all tokens are there apply. The most confident one decides
(then the larger support, then block before allow); with none the verdict is allow. Many URLs share a token set, so sets are
judged once, and URLs find their set's verdict by an equi-join that adaptive execution splits where a set is very common.

Everything runs inside the JVM: DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stash, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE, MOST_TOKENS = 0.005, 0.9, 3
#: Labelled URLs that a rule must rest on, and tokens of a group.
LEAST, GROUP = 20, 3
#: Labels of a host that its longest suffix token has.
SUFFIX = 4
ALLOW, BLOCK = "allow", "block"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def curated(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: suffixes of the host, a deep host's first label, path segments, query keys, a fragment.

    Runs of digits in path segments count as one sign: page numbers say nothing.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.least(n, F.lit(SUFFIX))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, -i, i), ".")))).otherwise(F.array().cast("array<string>"))
    first = F.when(n > 3, F.array(F.concat(F.lit("label="), F.element_at(labels, 1)))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    keys = F.transform(F.filter(F.split(F.substring(query, 2, 2_000_000_000), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    fragment = F.when(F.coalesce(F.regexp_extract(url, _PARTS, 4), F.lit("")) != "", F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(suffixes, first, segments, keys, fragment)))


RULE_DDL = "antecedent array<string>, verdict string, confidence double, support double, key string"


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most_tokens: int = MOST_TOKENS, least: int = LEAST) -> DataFrame:
    """labelled (tokens, verdict): (antecedent, verdict, confidence, support, key) of the pruned rules, key the rarest token.

    Fewer than `least` rows, or rows without tokens, give no rules.
    """
    spark = labelled.sparkSession
    rows = stash(labelled.select("tokens", "verdict").withColumn("row", F.monotonically_increasing_id()))  # numbered as it is written
    total, blocked = rows.agg(F.count("*"), F.sum((F.col("verdict") == BLOCK).cast("long"))).first()
    need = max(least, math.ceil(min_support * total))
    if total < need:
        return spark.createDataFrame([], RULE_DDL)
    where = (F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("in_rows"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("in_rows_too"))
    of_token = stash(rows.select("row", F.explode("tokens").alias("key")).groupBy("key").agg(*where).where(F.col("freq") >= need))
    together = of_token.groupBy("freq", "in_rows", "in_rows_too").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    frequent = stash(together.select(F.explode("keys").alias("key"), "freq", F.element_at("keys", 1).alias("first")))
    chosen = rows.select("row", "verdict", F.explode("tokens").alias("key")).join(frequent.where("key = first"), "key").groupBy("row", "verdict").agg(F.array_sort(F.collect_list("key")).alias("found"))
    items = stash(chosen.select("verdict", F.explode(_transactions(F.col("found"), most_tokens)).alias("part")).select(F.concat("part", F.array(F.concat(F.lit("="), "verdict"))).alias("items")))
    transactions = items.count()
    if transactions < need:
        return spark.createDataFrame([], RULE_DDL)
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / transactions).fit(items)
    is_verdict = lambda x: x.startswith("=")
    said = model.freqItemsets.where(F.exists("items", is_verdict) & F.size("items").between(2, most_tokens + 1))
    found = said.select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("antecedent")).distinct()
    keyed = found.select("antecedent", F.explode("antecedent").alias("key")).join(frequent.select("key", "freq"), "key")
    keyed = stash(keyed.groupBy("antecedent").agg(F.min(F.struct("freq", "key")).alias("least")).select("antecedent", F.col("least.key").alias("key")))

    sets = rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == BLOCK).cast("long")).alias("blocked"))
    fits = sets.select("tokens", "n", "blocked", F.explode("tokens").alias("key")).join(keyed, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    counted = fits.groupBy("antecedent", "key").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    each = counted.select("antecedent", "key", "n", F.explode(F.array(F.struct(F.lit(BLOCK).alias("verdict"), F.col("blocked").alias("both")), F.struct(F.lit(ALLOW).alias("verdict"), (F.col("n") - F.col("blocked")).alias("both")))).alias("x"))
    each = each.where((F.col("x.both") >= need) & (F.col("x.both") >= min_confidence * F.col("n")))
    rules = stash(each.select("antecedent", "x.verdict", (F.col("x.both") / F.col("n")).alias("confidence"), (F.col("x.both") / F.lit(float(total))).alias("support"), "key"))

    parts = rules.select("antecedent", "verdict", F.explode(_parts("antecedent", most_tokens)).alias("part"), F.col("confidence").alias("own"))
    shorter = rules.select(F.col("antecedent").alias("part"), "verdict", "confidence")
    spare = parts.join(shorter, ["part", "verdict"]).where("confidence >= own").select("antecedent", "verdict").distinct()
    told = rules.join(spare, ["antecedent", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support", F.array().cast("array<struct<freq:long,key:string>>").alias("told"))
    for i in range(most_tokens):  # each token of a rule stands for those that it always stands with
        like = frequent.select(F.col("first").alias("place"), F.struct("freq", "key").alias("each"))
        told = told.withColumn("place", F.get("antecedent", F.lit(i))).join(like, "place", "left")
        told = told.withColumn("told", F.when(F.col("each").isNull(), F.col("told")).otherwise(F.concat("told", F.array("each")))).drop("place", "each")
    out = stash(told.select(F.array_sort(F.transform("told", lambda x: x["key"])).alias("antecedent"), "verdict", "confidence", "support", F.array_min("told")["key"].alias("key")))
    for spent in (rows, of_token, frequent, items, keyed, rules):
        drop(spent)
    return out


def _transactions(tokens: Column, most: int) -> Column:
    """Arrays of at most most * GROUP tokens that hold every combination of up to `most` of them."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tokens) / GROUP).cast("int") - 1, F.lit(0))), lambda i: F.slice(tokens, i * GROUP + 1, GROUP))
    last = F.size(groups) - 1

    def chosen(part: Column, after: Column, left: int) -> Column:
        """part joined with each `left` groups behind the place `after`."""
        if not left:
            return F.array(part)
        rest = F.sequence(after + 1, last - (left - 1))
        return F.flatten(F.transform(rest, lambda i: chosen(F.concat(part, F.element_at(groups, i + 1)), i, left - 1)))

    none = F.slice(tokens, 1, 0)
    return F.when(F.size(groups) <= most, F.array(tokens)).otherwise(chosen(none, F.lit(-1), most))


def _parts(column: str, most: int) -> Column:
    """All smaller non-empty parts of a sorted array of at most `most` entries."""
    at = F.sequence(F.lit(1), F.lit(2**most - 2))
    subset = lambda mask: F.filter(column, lambda x, i: F.getbit(mask, i) == 1)
    return F.filter(F.array_distinct(F.transform(at, lambda mask: subset(mask.cast("long")))), lambda p: (F.size(p) > 0) & (F.size(p) < F.size(column)))


def judge_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets (tokens): (tokens, said) of the sets that a rule applies to."""
    looked = sets.select("tokens", F.explode("tokens").alias("key")).join(rules, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (F.col("verdict") == BLOCK).alias("blocks"), "verdict"))
    return looked.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.verdict").alias("said"))


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url, ...): (page_id, host, path, rule, verdict), a row for each row.

    Null URLs and those without :// have an empty host and path and no tokens: no curated rule fits unless its path is
    empty, no mined one applies, and the verdict is allow. URLs may be of any length. Rows that repeat a page_id or a URL are judged each for itself.
    Other columns are not read. An empty table gives an empty one.
    """
    url = F.col("url").cast("string")
    given = pages.select(F.col("page_id").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = curated(F.col("host"), F.col("path"), rules)
    seen = given.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(seen.where("rule is not null").select("tokens", "verdict"))
    said = judge_sets(seen.where("rule is null").select("tokens").distinct(), mined)
    return seen.join(said, "tokens", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "said", F.lit(ALLOW)).alias("verdict"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))
