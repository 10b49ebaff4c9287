"""Operator 5, toxicity: a counterfactually regularised classifier.

A logistic model over the words of a text and their stems, hashed into FEATURES weights. A document is scored sentence
by sentence: the most toxic sentences decide, so that one insult in a long text is not washed out, and every sentence of the
whole text is looked at.

Training: a labelled sentence is copied with a group's name swapped for another's, and the loss gets SWAP * (score - score of
the copy) ** 2. A weight on the name itself raises that penalty, so the model learns to score what is said and not whom it
mentions. Names come from two places: IDENTITY lists them in the languages of the tables, and the labelled text itself shows
which terms stand for each other: two sentences that are equal but for one term, in documents of one label, are a
counterfactual that was observed, and each is swapped for the other. Terms between which the label changed are no such pair.

Sentences have no labels of their own: the model is fitted on documents, a document's score being the soft maximum over its
sentences, so the gradient goes to the sentences that made it: to each by its share, however many there are. A sentence has
each of its features once, in training and in scoring.

Fitted on at most SAMPLE labelled documents of SAMPLE_BYTES (documented bounds; those with the smallest hash of doc_id), scored
on all.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, table
from .memo import Memo

FEATURES = 1 << 16
#: Labelled documents that the model is fitted on at most.
SAMPLE = 4000
#: Bytes of their texts at most.
SAMPLE_BYTES = 96 << 20
EPOCHS, RATE, DECAY = 10, 0.6, 1e-3
#: Documents that must hold a feature for it to count, and lengths of beginnings of words that are features.
RARE, STEMS = 6, (4, 5, 6, 7, 8)
#: Weights below this are none.
FAINT = 0.02
#: Weight of the counterfactual penalty.
SWAP = 2.0
#: The score of every text where the labels say nothing.
NO_EVIDENCE = 0.25
#: Sharpness of the soft maximum over sentences.
SHARP = 3.0
#: Words of sentences that are looked through for observed counterfactuals.
FRAME = (4, 40)
# Groups whose names stand for each other in counterfactual copies (English, German, French, Spanish).
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "flüchtlinge", "einheimische", "zuwanderer"),
    ("schwule", "lesben", "heterosexuelle"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "bouddhistes", "athées"),
    ("étrangers", "réfugiés", "immigrés", "français"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "budistas", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes", "nativos"),
)
SWAPS = {name: group[(i + 1) % len(group)] for group in IDENTITY for i, name in enumerate(group)}

POWERS = np.cumprod(np.full(FRAME[1], 0x9E3779B97F4A7C15, np.uint64))

_sentence = re.compile(r"[.!?\n]+")
_word = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, lower-cased; at least one (empty) sentence."""
    return [w for s in _sentence.split(text.lower()) if (w := _word.findall(s))] or [[]] if text else [[]]


def swapped(words: list[str]) -> list[str] | None:
    """The sentence with each group's name replaced; None where it names none."""
    new = [SWAPS.get(w, w) for w in words]
    return new if new != words else None


def hash64(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _frames(words: list[str]) -> np.ndarray:
    """A hash of the sentence without its k-th word, for each k; the place of the gap is part of it."""
    n = len(words)
    each = np.fromiter(map(hash64, words), np.uint64, n) * POWERS[:n]
    return mix64(each.sum() - each + POWERS[FRAME[1] - n : FRAME[1]] + np.uint64(n))


def observed(documents: list[list[list[str]]], labels: list[int]) -> dict[tuple[int, int], list[tuple[int, str]]]:
    """(document, sentence) -> [(place, other term)]: what sentences of one label show to stand for each other.

    Sentences that are equal but for one term share a frame. Where all documents of a frame have one label, each of its terms
    is swapped for the next one; a frame with both labels says that its terms matter.
    """
    frame, owner, seen = [], [], set()
    for d, parts in enumerate(documents):
        for k, words in enumerate(parts):
            if FRAME[0] <= len(words) <= FRAME[1] and (key := (hash64(" ".join(words)), labels[d])) not in seen:
                seen.add(key)
                frame.append(_frames(words))
                owner.append(np.arange(len(words), dtype=np.int64) + ((d << 40) + (k << 8)))
    if not frame:
        return {}
    frames, owners = np.concatenate(frame), np.concatenate(owner)
    del frame, owner, seen
    order = np.argsort(frames, kind="stable")
    frames, owners = frames[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], frames[1:] != frames[:-1]]))
    ends = np.append(starts[1:], len(frames))
    out: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for lo, hi in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        rows = [(int(o) >> 40, int(o) >> 8 & 0xFFFFFFFF, int(o) & 0xFF) for o in owners[lo:hi]]
        if len({labels[d] for d, _, _ in rows}) == 1:
            terms = [documents[d][k][place] for d, k, place in rows]
            for i, (d, k, place) in enumerate(rows):
                other = terms[(i + 1) % len(terms)]
                if other != terms[i]:
                    out.setdefault((d, k), []).append((place, other))
    return out


def counterfactuals(documents: list[list[list[str]]], labels: list[int]) -> list[list[tuple[int, list[str]]]]:
    """For each document the (sentence, its words with names swapped) of its sentences that have such."""
    out, seen = [[] for _ in documents], observed(documents, labels)
    for d, parts in enumerate(documents):
        for k, words in enumerate(parts):
            if (other := swapped(words)) is not None:
                out[d].append((k, other))
            for place, term in seen.get((d, k), ()):
                out[d].append((k, [*words[:place], term, *words[place + 1 :]]))
    return out


def _slots_of(word: str) -> tuple[int, ...]:
    """A word's features: itself and its beginnings, which stand for its stem; 0 is the bias."""
    crc, n = zlib.crc32, len(word)
    return tuple(crc(p.encode()) % (FEATURES - 1) + 1 for p in (f"{word} ", *[word[:k] for k in STEMS if n > k]))


_slots = Memo(_slots_of, 20_000)


def slots(words: list[str]) -> np.ndarray:
    """The distinct features of a sentence."""
    return np.array(sorted({0, *(s for w in words for s in _slots[w])}), np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def no_evidence(labels: list[int]) -> bool:
    """Whether the labels lack one of the two classes: then nothing tells them apart."""
    return not 0 < sum(labels) < len(labels)


def _soft(raw: np.ndarray) -> np.ndarray:
    pull = np.exp(SHARP * (raw - raw.max()))
    return pull / pull.sum()


def fit(labelled: list[tuple[str, int]], swap: float = SWAP, seed: int = 5) -> np.ndarray:
    """Weights from (text, 0 or 1); features of fewer than RARE documents get none.

    Without rows of both labels there is no evidence against any text: no weight but a bias that scores all NO_EVIDENCE.
    """
    random = np.random.default_rng(seed)
    weights, squares, seen = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES, np.int32)
    if no_evidence([y for _, y in labelled]):
        weights[0] = np.log(NO_EVIDENCE / (1 - NO_EVIDENCE))
        return weights
    documents = []  # (features of all sentences in a row, where each begins, counterfactual copies, label)
    words = [[list(map(sys.intern, p)) for p in sentences(text)] for text, _ in labelled]  # one object a word
    for parts, others, (_, label) in zip(words, counterfactuals(words, [y for _, y in labelled]), labelled):
        each = [slots(p) for p in parts]
        copies = [(i, slots(other)) for i, other in others]
        _slots.trim()
        documents.append((np.concatenate(each), np.cumsum([0, *map(len, each)], dtype=np.int32), copies, label))
        seen[np.unique(documents[-1][0])] += 1
    del words
    names = np.array([s for w in SWAPS for s in _slots[w]])
    common = seen >= RARE
    common[names] |= seen[names] > 0
    common[0] = True  # the bias leads every sentence, so none is without features
    for k, (features, bounds, copies, label) in enumerate(documents):
        kept = common[features]
        upto = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        at, where = np.unique(features[kept], return_inverse=True)
        documents[k] = (at, where.astype(np.int32), upto[bounds], [(i, o[common[o]]) for i, o in copies], label)
    positives = sum(d[-1] for d in documents)
    balance = {1: 0.5 * len(documents) / max(positives, 1), 0: 0.5 * len(documents) / max(len(documents) - positives, 1)}

    def step(at: np.ndarray, gradient) -> None:
        g = gradient + DECAY * weights[at]
        squares[at] += g * g
        weights[at] -= RATE * g / np.sqrt(squares[at])

    for _ in range(EPOCHS):
        for k in random.permutation(len(documents)):
            at, where, bounds, copies, label = documents[k]
            raw = np.add.reduceat(weights[at][where], bounds[:-1])
            pull = _soft(raw)
            error = balance[label] * (_sigmoid(float(raw @ pull)) - label)
            step(at, error * np.bincount(where, np.repeat(pull, np.diff(bounds))))
            for i, other in copies:
                own = at[where[bounds[i] : bounds[i + 1]]]
                s, t = _sigmoid(weights[own].sum()), _sigmoid(weights[other].sum())
                pulled = 2 * swap * (s - t)
                step(np.setdiff1d(own, other), pulled * s * (1 - s))
                step(np.setdiff1d(other, own), -pulled * t * (1 - t))
    weights[1:][np.abs(weights[1:]) < FAINT] = 0
    return weights


class Scorer:
    """text -> score from 0 to 1, over all sentences of the whole text, each with its distinct features as in fit()."""

    def __init__(self, weights: np.ndarray):
        self.bias, self.weights = float(weights[0]), weights.tolist()
        self.number = list(range(len(weights)))  # one object a feature, whatever the number of words that have it
        self.word = Memo(self._of_word, 100_000)

    def _of_word(self, word: str) -> tuple[int, ...]:
        """The word's features that have a weight; none for most words."""
        weights, number = self.weights, self.number
        return tuple([number[s] for s in _slots_of(word) if weights[s]])

    def raw(self, words: list[str]) -> float:
        return self.bias + sum(map(self.weights.__getitem__, set().union(*map(self.word.__getitem__, words))))

    def __call__(self, text: str | None) -> float:
        self.word.trim()
        raw = np.array([self.raw(p) for p in sentences(text)])
        return float(_sigmoid(float(raw @ _soft(raw))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, sample: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most `sample` (text, label) of rows outside the held-out fold, those with the smallest hash of doc_id.

    Of these the first ones up to most_bytes of text, whatever the length of the texts (and the one that goes beyond).
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (fold != held_out)).dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("__id") == chosen["doc_id"]).select("doc_id", "text", "y").dropDuplicates(["doc_id"])
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # over `sample` rows at most
    rows = rows.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < most_bytes)
    return [(r["text"] or "", r["y"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def score_documents(docs: DataFrame, model, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; model: text -> score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    return docs.select("doc_id", fold.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scorer_of(held) -> Scorer:
    """One per worker and model."""
    if held.id not in _scorers:
        _scorers.clear()
        _scorers[held.id] = Scorer(held.value)
    return _scorers[held.id]


class _Held:
    """Weights on their way to the workers."""

    def __init__(self, broadcast):
        self.id, self.broadcast = uuid.uuid4().hex, broadcast

    @property
    def value(self):
        return self.broadcast.value


_scorers: dict[str, Scorer] = {}


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """text -> score, learnt from labels (doc_id, toxic) of rows whose crc32(doc_id as text) mod 5 is not 0."""
    weights = fit(training_rows(docs, labels, "toxic", 5, 0, sample)).astype(np.float32)
    _slots.clear(), _slots.elder.clear()
    held = _Held(docs.sparkSession.sparkContext.broadcast(weights))  # FEATURES numbers, whatever the input
    return lambda text: scorer_of(held)(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, toxic, ...): (doc_id, held_out, score, predicted), a row for each row.

    Null and empty texts get the score of a sentence without words. Rows that repeat a doc_id, or have none (never held
    out), are scored each for itself; of labels that repeat a doc_id one counts, those without 0 or 1 do not. Without labels of
    both kinds every score is NO_EVIDENCE and none is predicted toxic. Nothing but the text enters a score, other columns are
    not read. An empty table gives an empty one.
    """
    return score_documents(docs, toxicity_model(docs, labels), 5, 0)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay as they are.

    Null and empty texts are scored as texts without words, repeated rows each for itself. Without labels of both kinds there
    is no evidence against any row, and all stay. An empty table gives an empty one.
    """
    model, names = toxicity_model(docs, labels), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model(t) < 0.5 for t in batch.column(names.index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
