"""Operator 13, scans for secrets: formats, and values of credential contexts that take too many guesses.

Formats (assign, access, hex) are found as they are. Beyond them, a value that stands where credentials stand (behind a key
word and a sign, a scheme of authorization between them or not, or as the password of a URL) is a secret if no cheap way leads to it. Its
cost is the smallest over all ways to cut it into segments, in bits (the logarithm of the number of guesses):

    word          how rare the word is among all words of the corpus, its capitals and its digits for letters
    date          days of two centuries, or years
    repeat        the repeated unit and how often it stands
    walk          neighbouring keys of a keyboard, or of the alphabet; turns cost
    brute force   a letter, digit or sign at a time

and each segment SEGMENT bits more. A value of at least SECRET bits is a secret; placeholders, words with a number behind
them, dates and walks are none.

1. One pass finds the values, each once a task. Of each distinct one two bounds are computed without any word list: with no
   words at all the cost is too high, with every run of letters as the most frequent word it is too low. Most values are
   settled by that, as keys and short placeholders are.
2. For the others the runs of letters that could matter are joined with the corpus's word counts. These come from all texts,
   without the values themselves. A word that is one of m takes m guesses at most, if words are tried by their frequency. A
   filter of SIEVE bits, of whatever words are asked for, spares the shuffle most words that none asks for.
3. The secrets found are joined with the texts by digests.

A value of any length is decided: once all ways cost SECRET bits, nothing that follows makes them cheaper.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stash, table

KINDS = ("assign", "access", "hex")
ADDED = "guess"
#: log2 of 10^10 guesses: out of reach where each is slow.
SECRET = 10 * math.log2(10)
SEGMENT = 1.0
#: Letters of a word, and the longest segment but repeats and walks.
SHORTEST, LONGEST = 3, 24
#: Characters of a repeated unit at most.
UNIT = 16
#: Occurrences outside of values that make a run of letters a word.
LEAST = 3
#: Distinct words a task holds before it sends what it has, and bits of the filter that tells most words nobody asks for.
WORDS, SIEVE = 50_000, 1 << 18

# Fixed values of the formats.
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_access = re.compile(r"AKIA[A-Z0-9]{12,}")
_hex = re.compile(r"[0-9a-f]{32,}")

#: Words before a sign that a credential follows; also part of a longer name, as in db_password.
KEYS = ("password", "passwd", "passphrase", "passcode", "passwort", "kennwort", "pwd", "pass", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "private-key", "credential", "credentials", "auth", "authorization", "clave", "senha", "contraseña", "mot de passe")
_longest_key = max(map(len, KEYS))
_behind = re.compile(r"""(?::=|=>|[:=])\x20*(?:bearer\x20+|basic\x20+)?["'`]?([^\s"'`<>]+)""", re.ASCII | re.IGNORECASE)
_login = re.compile(r"""://[^\s/?#:@"'`<>]+:([^\s/?#@"'`<>]+)@""")
_quotes, _trailing = "\"'`", ".,;:!?)]}"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Formats in order of start, then of kind; leftmost, not overlapping within a kind; failing matches are dropped."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in ("passw", "secret", "token", "api")):
            out += [("assign", *m.span()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [("access", *m.span()) for m in _access.finditer(text)] if "AKIA" in text else []
    out += [("hex", *m.span()) for m in _hex.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _places(text: str, sign: str) -> Iterator[int]:
    at = text.find(sign)
    while at >= 0:
        yield at
        at = text.find(sign, at + 1)


def _has_key(text: str, at: int) -> bool:
    """Whether a key word stands before the sign at this place, with a quote and blanks between them or not."""
    while at and text[at - 1] == " ":
        at -= 1
    if at and text[at - 1] in _quotes:
        at -= 1
    return text[max(0, at - _longest_key) : at].lower().endswith(KEYS)


def values(text: str) -> list[tuple[int, int]]:
    """Where the values of credential contexts stand, without the punctuation behind them; none overlaps another."""
    spans = {m.span(1) for sign in ":=" for at in _places(text, sign) if _has_key(text, at) and (m := _behind.match(text, at))}
    spans |= {m.span(1) for m in _login.finditer(text)} if "://" in text else set()
    out, end = [], 0
    for a, b in sorted(spans):
        if a < end:
            continue
        end = b
        while b > a and text[b - 1] in _trailing:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


# --- the cost of a value ---------------------------------------------------------------------------------------------

ROWS = ((0.0, "1234567890-="), (0.5, "qwertyuiop[]"), (0.75, "asdfghjkl;'"), (1.25, "zxcvbnm,./"))


def _neighbours() -> dict[tuple[str, str], tuple]:
    """(key, key) -> direction, for keys that touch, and for letters and digits that follow each other."""
    place = {c: (x + i, y) for y, (x, row) in enumerate(ROWS) for i, c in enumerate(row)}
    out = {}
    for a, (ax, ay) in place.items():
        for b, (bx, by) in place.items():
            if a != b and abs(by - ay) <= 1 and abs(bx - ax) <= 1:
                out[a, b] = (bx > ax, by - ay)
    for line in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(line, line[1:]):
            out.setdefault((a, b), "up"), out.setdefault((b, a), "down")
    return out


NEIGHBOURS = _neighbours()
KEYBOARD = math.log2(48)
TURN = math.log2(5)
#: Digits and signs that stand for letters.
FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_date = re.compile(r"(?:19|20)\d\d|(?:0?[1-9]|[12]\d|3[01])[-./]?(?:0?[1-9]|1[0-2])[-./]?(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d[-./]?(?:0?[1-9]|1[0-2])[-./]?(?:0?[1-9]|[12]\d|3[01])", re.ASCII)
DATE_LONGEST = 10
YEAR, DAY, PART = math.log2(200), math.log2(200 * 366), 2.0
DIGIT, LETTER, SIGN, OTHER = math.log2(10), math.log2(26), math.log2(33), math.log2(10_000)


def character(c: str) -> float:
    if c.isascii():
        return LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN
    return OTHER


def folded(text: str) -> str:
    """text in small letters, with letters for the digits and signs that stand for them; as long as text."""
    return "".join(FOR_LETTERS.get(c) or (low if len(low := c.lower()) == 1 else c) for c in text)


def spelling(piece: str) -> float:
    """Bits that a piece has beside its word: for capitals and for what stands for letters."""
    letters, capitals = sum(map(str.isalpha, piece)), sum(map(str.isupper, piece))
    bits = 0.0 if not capitals else 1.0 if capitals == letters or piece[0].isupper() and capitals == 1 else math.log2(math.comb(letters, capitals)) + 1
    return bits + (1.0 + 0.5 * (len(piece) - letters) if len(piece) > letters else 0.0)


def cost(value: str, word_bits: Callable[[str], float | None], enough: float = SECRET) -> tuple[float, int]:
    """(the smallest number of bits, how many characters were looked at); once all ways cost `enough`, what is reached so far.

    word_bits gives the bits of a word, None for none.
    """
    low, plain = "".join(c.lower() if c.isascii() else c for c in value), folded(value)
    letters = [0, *accumulate(map(str.isalpha, value))]
    word_start = 0
    best, runs, walk, walk_start = [0.0], [0] * (UNIT + 1), [], 0
    units: dict[str, float] = {}
    for i, c in enumerate(value):
        least = best[i] + character(c)
        if not plain[i].isalpha():
            word_start = i + 1
        for start in range(max(word_start, i + 1 - LONGEST), i + 2 - SHORTEST):
            if letters[i + 1] - letters[start] >= 2 and best[start] < least and (bits := word_bits(plain[start : i + 1])) is not None:
                least = min(least, best[start] + bits + spelling(value[start : i + 1]))
        if c.isdigit():
            for start in range(max(0, i + 1 - DATE_LONGEST), i - 2):
                if best[start] + YEAR < least and _date.fullmatch(value, start, i + 1):
                    piece = value[start : i + 1]
                    least = min(least, best[start] + (YEAR if len(piece) == 4 and piece[:2] in ("19", "20") else DAY + PART * (not piece.isdigit())))
        longest = 0
        for p in range(1, min(UNIT, i) + 1):
            runs[p] = runs[p] + 1 if c == value[i - p] else 0
            longest = max(longest, runs[p] and runs[p] + p)
            if runs[p] >= max(p, 2):
                start, unit = i + 1 - runs[p] - p, value[i + 1 - p : i + 1]
                if unit not in units:
                    units[unit] = cost(unit, word_bits, math.inf)[0]  # units of units are shorter
                least = min(least, best[start] + units[unit] + math.log2((runs[p] + p) / p + 1))
        way = NEIGHBOURS.get((low[i - 1], low[i])) if i else None
        if way is None:
            walk, walk_start = [], i
        else:
            walk.append((way, walk[-1][1] + (walk[-1][0] != way) if walk else 1))  # and the turns so far
        if len(walk) >= 2:
            longest = max(longest, len(walk) + 1)
            for start in {walk_start, *range(max(walk_start, i + 1 - LONGEST), i - 1)}:
                turns = walk[-1][1] - walk[start - walk_start][1] + 1
                least = min(least, best[start] + KEYBOARD + math.log2(i + 1 - start) + TURN * turns)
        best.append(least + SEGMENT)
        # every way passes through one of the last LONGEST places, unless a longer repeat or walk spans them
        if longest <= LONGEST and min(best[-LONGEST:]) >= enough:
            return min(best[-LONGEST:]), i + 1
    return best[-1], len(value)


def pieces(value: str, until: int) -> set[str]:
    """The words that runs of the first characters could stand for: two letters at least, and what stands for letters."""
    plain, letters, out, start = folded(value), [0, *accumulate(map(str.isalpha, value))], set(), 0
    for b in range(1, until + 1):
        if not plain[b - 1].isalpha():
            start = b
        out.update(plain[a:b] for a in range(max(start, b - LONGEST), b + 1 - SHORTEST) if letters[b] - letters[a] >= 2)
    return out


def bounds(value: str) -> tuple[bool | None, set[str]]:
    """(whether value is a secret, as far as that holds for all word lists; the words that decide it otherwise)."""
    if cost(value, lambda w: None)[0] < SECRET:
        return False, set()
    least, until = cost(value, lambda w: 0.0)
    return (True, set()) if least >= SECRET else (None, pieces(value, until))


# --- over the corpus -------------------------------------------------------------------------------------------------

_letters = re.compile(r"[^\W\d_]{%d,}" % SHORTEST)


def _digest(value: str) -> str:
    return hashlib.md5(value.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, digest, value): the values of each text, by the texts' digests."""
    for batch in batches:
        rows = []
        for digest, text in zip(batch.column("of_text").to_pylist(), batch.column("text").to_pylist()):
            for value in {text[a:b] for a, b in values(text)}:
                rows.append((digest, _digest(value), value))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [()] * 3], names=["of_text", "digest", "value"])


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, value, secret, words) of distinct values; secret is null where word counts decide."""
    for batch in batches:
        found = [bounds(v) for v in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("value"), pa.array([s for s, _ in found], pa.bool_()), pa.array([sorted(w) for _, w in found], pa.list_(pa.string()))], names=["digest", "value", "secret", "words"])


def _count(sieve):
    """(word, n): words outside of values that pass the sieve, summed in the task first; and all words together (word null)."""

    def send(words: Counter, total: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([None, *words], pa.string()), pa.array([total, *words.values()], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, passes = Counter(), 0, sieve.value
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column("text").to_pylist():
                at = 0
                for a, b in [*values(text), (len(text), len(text))] if text else ():
                    words.update(_letters.findall(text[at:a]))
                    at = b
            total += words.total()
            for word, n in words.items():
                if passes[_sieve(low := word.lower())]:
                    held[low] += n
            if len(held) > WORDS:
                yield send(held, total)
                held, total = Counter(), 0
        yield send(held, total)

    return run


def _sieve(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SIEVE


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, secret) with the bits of the words that the corpus knows."""
    for batch in batches:
        known = [{w["word"]: w["bits"] for w in row or ()} for row in batch.column("known").to_pylist()]
        secret = [cost(v, k.get)[0] >= SECRET for v, k in zip(batch.column("value").to_pylist(), known)]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(secret, pa.bool_())], names=["digest", "secret"])


def _may_hold(text: Column) -> Column:
    """Whether a text has a sign that values stand behind."""
    return text.contains(":") | text.contains("=")


def word_bits(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """docs (text), asked (word): (word, bits) of the asked words that occur LEAST times at least."""
    passes = bytearray(SIEVE)
    for r in asked.select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(SIEVE)).alias("at")).distinct().collect():  # at most SIEVE rows
        passes[r["at"]] = 1
    sieve = docs.sparkSession.sparkContext.broadcast(bytes(passes))
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(sieve), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stash(counts)
    total = counts.where("word is null").first()["n"]
    return counts.where(f"word is not null and n >= {LEAST}").select("word", F.log2(F.lit(float(total)) / F.col("n")).alias("bits"))


def secret_values(docs: DataFrame) -> DataFrame:
    """docs (text): (of_text, digest), of each text (by its MD5) that has any, the secrets among its values (by theirs)."""
    text = F.col("text").cast("string")
    sought = stash(docs.where(_may_hold(text)).select(F.md5(text.cast("binary")).alias("of_text"), text.alias("text")).mapInArrow(_seek, "of_text string, digest string, value string").dropDuplicates(["of_text", "digest"]))
    each = stash(sought.select("digest", "value").dropDuplicates(["digest"]).mapInArrow(_bound, "digest string, value string, secret boolean, words array<string>"))
    found, open_ = each.where("secret").select("digest"), each.where("secret is null")
    if not open_.isEmpty():
        words = open_.select("digest", F.explode("words").alias("word"))
        hits = words.join(word_bits(docs, words), "word").groupBy("digest").agg(F.collect_list(F.struct("word", "bits")).alias("known"))
        decided = open_.select("digest", "value").join(hits, "digest", "left").mapInArrow(_decide, "digest string, secret boolean")
        found = found.unionAll(decided.where("secret").select("digest"))
    out = stash(sought.select("of_text", "digest").join(found, "digest"))
    drop(sought), drop(each)
    return out


def _find(keep_text: bool):
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", f"n_{ADDED}"] + ["redacted"] * keep_text
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, secrets in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "secrets"))):
                base = base_spans(text or "")
                added = beyond_formats(text, base, set(secrets)) if secrets else []
                every = sorted(base + added, key=lambda s: (s[1], (*KINDS, ADDED).index(s[0]), s[2])) if added else base
                n = Counter(k for k, _, _ in base)
                row = (doc_id, *(n[k] for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(added))
                out.append((*row, redacted(text, every)) if keep_text else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(names), kinds)], names=names)

    return run


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def beyond_formats(text: str, base: list[Span], secrets: set[str]) -> list[Span]:
    """The values of text that are secrets (by digest) and do not lie in a base span."""
    return [(ADDED, a, b) for a, b in values(text) if _digest(text[a:b]) in secrets and not any(s <= a and b <= e for _, s, e in base)]


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """text with [SECRET] in the place of each span; spans that overlap are one."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def secrets(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...): (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess [, redacted]), a row a row.

    spans has the formats and, as guess:start:end, the credentials that cost too many guesses and lie in no format's span, by
    start. Null and empty texts have none; redacted is null where text is. Texts and values of any length are read whole. Rows
    that repeat a doc_id, or have none, are searched each for itself. Words are counted over all rows, repeated ones as often
    as they stand. Other columns, whatever their names, are not read. An empty table gives an empty one.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = stash(secret_values(given).groupBy("of_text").agg(F.collect_set("digest").alias("secrets")))
    # texts without a context match nothing: keys of their own keep them apart
    key = F.when(_may_hold(F.col("text")), F.md5(F.col("text").cast("binary"))).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id()))
    # held is written out, so its size is known: while it is small, no text is shuffled
    joined = given.withColumn("key", key).join(held, F.col("key") == F.col("of_text"), "left").select("doc_id", "text", "secrets")
    kinds = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_{ADDED} long"
    return joined.mapInArrow(_find(keep_text), kinds + ", redacted string" * keep_text)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
