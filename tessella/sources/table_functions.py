"""Table functions for SQL: a text's chunks and a file's pages, called with LATERAL on any table that has texts."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.text import EDGES, WORD
from ..operators.prepare import merge_small, split_text

#: What Spark's patterns mean by white space.
BLANK = r"\x20\t\n\x0b\f\r"


def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(f"[^{WORD}\\s]", f"[^{WORD}{BLANK}]").replace(r"\s", f"[{BLANK}]"))


_strip = _compiled(r"^\s+|\s+$")
_edges = [(_compiled(pattern), to.replace("$2", r"\2")) for pattern, to in EDGES]
_after_torn = _compiled(f"(?s)^.*?\\s+([{WORD}].*)$")


def strip(text: str) -> str:
    return _strip.sub("", text)


def cleaned(text: str) -> str:
    """functions.text.boundary_clean() of one text."""
    out = strip(text)
    for pattern, to in _edges:
        out = pattern.sub(to, out)
    out = strip(out)
    if out and out[0] != out[0].upper() and out[0] == out[0].lower() and (found := _after_torn.match(out)):
        return strip(found[1]) or out
    return out


class ChunkText:
    """chunk_text(text [, size, overlap, least]): (chunk_index, chunk_total, chunk), as operators.prepare.chunks() has them.

    A null or blank text has no chunk.
    """

    def eval(self, text: str, size: int = 512, overlap: int = 256, least: int = 256) -> Iterator[tuple[int, int, str]]:
        found = [c for c in map(cleaned, merge_small(split_text(text or "", size, overlap), least)) if c]
        for i, chunk in enumerate(found):
            yield i, len(found), chunk


class PagesOf:
    """pages_of(text [, least]): (page, text), the pages of a text whose pages end with a form feed; pages that are blank go.

    least is the number of characters that a page must have.
    """

    def eval(self, text: str, least: int = 1) -> Iterator[tuple[int, str]]:
        for i, page in enumerate((text or "").split("\f")):
            if len(strip(page)) >= least:
                yield i + 1, page


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL by name."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, chunk_total int, chunk string", useArrow=True))
    spark.udtf.register("pages_of", udtf(PagesOf, returnType="page int, text string", useArrow=True))
