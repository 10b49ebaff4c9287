"""Text scalars as Column -> Column functions; all but normalize() run inside code generation.

Patterns are written once, as data, and rendered for Spark (Java) and, for the oracles, for RE2: there \\b is ASCII-only, so a
leading word boundary becomes an explicit class whose character is put back.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"

# Words and word endings that glued text is split at.
PREPOSITIONS = ("of", "in", "on", "to", "by", "at", "for", "with", "from", "into")
CONJUNCTIONS = ("the", "and", "but", "or")
ENDINGS = ("tion", "ness", "ment", "able", "ible")

#: (pattern, replacement) in order; $n stands for group n, and @ for a leading word boundary, which the two engines need in
#: different forms: RE2's \b knows only ASCII, so there it becomes a group that is put back, and the groups' numbers move.
GLUED = (
    ("([a-z])([A-Z])", "$1 $2"),
    ("([a-zA-Z])([0-9])", "$1 $2"),
    ("([0-9])([a-zA-Z])", "$1 $2"),
    (r"([a-zA-Z])([\.,:;!?])", "$1 $2"),
    (r"([\.,:;!?])([a-zA-Z])", "$1 $2"),
    *((f"@{w}([a-z]{{3,}})", f"{w} $1") for w in (*PREPOSITIONS, *CONJUNCTIONS)),
    *((f"@({w})([a-z]{{2,}})", "$1 $2") for w in ENDINGS),
    (r"\s+", " "),
)
TIDY = (
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    (r"^[0-9]+\s+", ""),
    (r"\.{2,}", "..."),
    (r"\?{2,}", "?"),
    (r"\!{2,}", "!"),
    (r"\s+([\.,:;!?])", "$1"),
    (r"([\.,:;!?])\s+", "$1 "),
)
EDGES = (
    (f"^[^{WORD}\\s]*", ""),
    (r"^\.\.\.+", ""),
    (r"\s*\.\.\.+$", ""),
    (f"^[a-z]{{1,2}}(\\s+|([^{WORD}\\s])|$)", "$2"),
)


#: GLUED's steps between two classes of characters, as one: each pair of neighbours is of one kind at most, so their order
#: does not matter, and a character is looked at once for all of them.
BETWEEN = (r"[a-z](?=[A-Z0-9\.,:;!?])|[A-Z](?=[0-9\.,:;!?])|[0-9](?=[a-zA-Z])|[\.,:;!?](?=[a-zA-Z])", "$0 ")


def replace_all(c: Column, steps) -> Column:
    """A leading word boundary is asked behind the word that follows it: so words are sought first, boundaries only there."""
    for pattern, to in steps:
        if pattern.startswith("@"):
            word, rest = pattern[1 : pattern.index("([a-z]")], pattern[pattern.index("([a-z]") :]
            pattern = rf"{word}(?<=(?U:\b){word.strip('()')}){rest}"
        c = F.regexp_replace(c, pattern, to)
    return c


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def replace_all_sql(expression: str, steps) -> str:
    """The same steps for DuckDB."""
    for pattern, to in steps:
        if pattern.startswith("@"):
            pattern = f"(^|[^{WORD}]){pattern[1:]}"
            to = r"\1" + to.replace("$2", r"\3").replace("$1", r"\2")
        else:
            to = to.replace("$1", r"\1").replace("$2", r"\2")
        expression = f"regexp_replace({expression}, '{pattern}', '{to}', 'g')"
    return expression


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_sql(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _re2(steps) -> list[tuple[str, str]]:
    """The steps as Arrow's kernels take them; white space is looked for only where folding changes something."""
    out = []
    for pattern, to in steps:
        if pattern.startswith("@"):
            pattern, to = f"(^|[^{WORD}]){pattern[1:]}", r"\1" + to.replace("$2", r"\3").replace("$1", r"\2")
        elif (pattern, to) == (r"\s+", " "):
            pattern = r"\s{2,}|[\t\n\f\r]"
        out.append((pattern, to.replace("$1", r"\1").replace("$2", r"\2")))
    return out


_STRIP = (r"^\s+|\s+$", "")
NORMALIZING = _re2((*GLUED, _STRIP, *TIDY, _STRIP))
#: Texts that go through all steps at once.
TEXTS = 256


def normalized(texts: pa.Array) -> pa.Array:
    """normalize() over an Arrow array; a few texts at a time, so that they stay in the processor's cache."""
    out = []
    for at in range(0, len(texts), TEXTS):
        part = pc.fill_null(texts.slice(at, TEXTS), "")
        for pattern, to in NORMALIZING:
            part = pc.replace_substring_regex(part, pattern=pattern, replacement=to)
        out.append(part)
    return pa.concat_arrays(out) if out else texts


def normalize(c: Column) -> Column:
    """Split glued words, fold white space, drop control characters and a leading number, tidy punctuation. Not idempotent.

    Many steps over whole texts: Arrow's kernels (RE2, the oracle's engine) take less than half of the time of regexp_replace.
    """
    return F.arrow_udf(normalized, "string")(c.cast("string"))


def normalize_sql(e: str) -> str:
    inner = strip_sql(replace_all_sql(f"coalesce({e}, '')", GLUED))
    return f"CASE WHEN {strip_sql(f'''coalesce({e}, '')''')} = '' THEN '' ELSE {strip_sql(replace_all_sql(inner, TIDY))} END"


def is_valid(c: Column, least: int = 50, share: float = 0.7) -> Column:
    """Long enough, and long enough without what is neither word nor white space."""
    return F.coalesce((F.length(strip(c)) >= least) & (F.length(strip(F.regexp_replace(c, f"[^{WORD}\\s]", ""))) >= least * share), F.lit(False))


def clean_ascii(c: Column) -> Column:
    """White space folded, then everything outside printable ASCII dropped."""
    return F.regexp_replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), r"[^\x20-\x7E]", "")


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def text_stats(c: Column) -> dict[str, Column]:
    """Characters, words, lines and non-blank paragraphs; zeros for empty texts."""
    c = F.coalesce(c, F.lit(""))
    zero = lambda x: F.when(c == "", 0).otherwise(x).cast("long")
    return {
        "chars": zero(F.length(c)),
        "words": zero(F.size(words_of(c))),
        "lines": zero(F.size(F.split(c, "\n", -1))),
        "paragraphs": zero(F.size(F.filter(F.split(c, "\n\n", -1), lambda p: strip(p) != ""))),
    }


def valid_chunk(c: Column, least: int = 10, most: int = 2000) -> Column:
    return F.coalesce(F.length(strip(c)).between(least, most), F.lit(False))


def safe_file_name(c: Column) -> Column:
    """Characters that file systems refuse become one underscore; never empty."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*]', "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(name == "", "unnamed_file").otherwise(name)


def evaluation_form(c: Column) -> Column:
    """Lower case, punctuation to blanks, white space folded."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD}\\s]", " "), r"\s+", " "))


def terms(c: Column, least: int = 2) -> Column:
    """Search terms: runs of letters, digits and underscores, lower-cased, of at least two characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"([{WORD}]+)"), 1), lambda t: F.length(t) >= least)


def boundary_clean(c: Column) -> Column:
    """Strip a chunk's torn ends: punctuation, ellipses, a short torn word, a torn first word."""

    def torn(c: Column) -> Column:
        first = F.substring(c, 1, 1)
        rest = F.regexp_extract(c, f"(?s)^.*?\\s+([{WORD}].*)$", 1)
        return F.when((first != F.upper(first)) & (first == F.lower(first)), let(strip(rest), lambda r: F.when(r != "", r).otherwise(c))).otherwise(c)

    return let(strip(replace_all(strip(F.coalesce(c, F.lit(""))), EDGES)), torn)


def slug_title(c: Column) -> Column:
    """The last part of a URL's path as a title."""
    path = F.coalesce(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    last = F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1)), F.lit(""))
    title = F.regexp_replace(last, "[-_]", " ")
    for suffix in (".html", ".php", ".aspx"):
        title = F.replace(title, F.lit(suffix), F.lit(""))
    title = F.array_join(words_of(F.regexp_replace(title, r"\s+[0-9]+$", "")), " ")
    return F.when(title == "", "News Article").otherwise(F.initcap(title))


def decimals(c: Column, places: int) -> Column:
    """A number with so many decimals, rounded as printf does: by its binary value, exact ties to even (format_string rounds what toString() shows)."""
    return F.call_function("format_number", c.cast("double"), F.lit(f"0.{'0' * places}"))


def format_size(c: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal, a half rounded away from zero."""
    size = lambda power, unit: F.concat(decimals(F.round(c / 1024.0**power, 1), 1), F.lit(f" {unit}"))
    out = size(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(c < 1024 ** (power + 1), size(power, unit)).otherwise(out)
    return out


def processing_time(files: Column, kilobytes: Column) -> Column:
    """An estimate in words: a tenth of a second a file of 100 KB, more for larger ones. Rounded once, by the last division."""
    seconds = files * F.greatest(F.lit(100.0), kilobytes) / 1000
    said = lambda x, unit: F.concat(decimals(x, 1), F.lit(f" {unit}"))
    return F.when(seconds < 60, said(seconds, "seconds")).when(seconds < 3600, said(seconds / 60, "minutes")).otherwise(said(seconds / 3600, "hours"))


def source_path(c: Column) -> Column:
    """A source's path without the folders that knowledge bases are kept in."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
    for pattern in ("^[Dd]ata/[Kk]nowledge_?[Bb]ase/", "^[Dd]ata/", "^[Kk]nowledge_?[Bb]ase/"):
        c = F.regexp_replace(c, pattern, "")
    return c


def source_category(c: Column) -> Column:
    """The order of the tests matters: a news site's PDF is news."""
    low = F.lower(c)
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").when(low.contains("wikipedia"), "wikipedia").when(low.contains("news_site") | low.contains("news-site"), "news_site").when(c.endswith(".pdf"), "pdf").when(low.contains("book"), "books").otherwise("unknown")


def pdf_title(c: Column) -> Column:
    """The file's stem as a title; null for other files."""
    stem = F.regexp_replace(F.regexp_extract(source_path(c), "([^/]*)$", 1), r"\.pdf$", "")
    return F.when(c.endswith(".pdf"), F.initcap(F.array_join(words_of(F.lower(F.regexp_replace(stem, "[-_]", " "))), " ")))


def long_date(c: Column, milliseconds: bool = True) -> Column:
    """Epoch seconds or milliseconds, or an ISO date, as `Month DD, YYYY` in UTC; null if it is none.

    A number above 10^10 is milliseconds, unless the caller knows that all are seconds. Years above 9999 have no sign.
    """
    digits = c.rlike("^[0-9]+$")
    epoch = F.when(digits, c.try_cast("long"))
    moment = F.timestamp_seconds(F.when(epoch > 10_000_000_000, F.floor(epoch / 1000)).otherwise(epoch) if milliseconds else epoch)
    return F.replace(F.date_format(F.when(digits, moment).otherwise(c.try_cast("timestamp")), "MMMM dd, yyyy"), F.lit("+"), F.lit(""))


def citation(source: Column, title: Column, page: Column, date: Column, url: Column, milliseconds: bool = True) -> Column:
    """The citation text of a source's category; null where its title is missing. milliseconds: see long_date()."""
    kind, title, url = source_category(source_path(source)), F.nullif(title, F.lit("")), F.nullif(url, F.lit(""))
    paged = lambda t: F.when(page.isNotNull(), F.concat(t, F.lit(", p. "), page.cast("string"))).otherwise(t)
    day = long_date(date, milliseconds)
    news = F.nullif(F.concat_ws(", ", F.concat(F.lit('"'), title, F.lit('"')), day), F.lit(""))
    return (
        F.when(kind == "pdf", paged(pdf_title(source)))
        .when(kind == "wikipedia", F.when(day.isNotNull(), F.concat(title, F.lit(" (Wikipedia, accessed "), day, F.lit(")"))).otherwise(F.concat(title, F.lit(" (Wikipedia)"))))
        .when(kind == "news_site", F.when(url.isNotNull(), F.concat(news, F.lit(". Retrieved from "), url)).otherwise(news))
        .when(kind == "books", paged(title))
    )
