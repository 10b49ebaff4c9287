"""Operator 8, quality: a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes, each a learned vector of DIM numbers. FILTERS learned filters of WIDTH bytes are moved over it
by STEP bytes. The text is covered from end to end by chunks of CHUNK steps that overlap by a quarter; in each chunk a
filter's answers are max-pooled. The means and the maxima over the chunks, of every filter, are combined into one
probability. Both say different things: a maximum that junk is there at all, a mean how much of the text is junk.

As filters are two steps wide, each block of STEP bytes is multiplied once with both halves of the filters, and neighbours
are added: no window is ever copied. Texts are worked through in slices of SLICE bytes, so memory does not follow their length.

Fitted on at most SAMPLE labelled documents (a documented bound; those with the smallest hash of doc_id), scored on all.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .toxicity import no_evidence, score_documents, training_rows

DIM, STEP, FILTERS = 8, 4, 24
WIDTH = 2 * STEP
#: Steps of a chunk, and from one chunk to the next.
CHUNK, STRIDE = 64, 48
#: Bytes that are looked at at once.
SLICE = 1 << 18
SAMPLE, EPOCHS, RATE, MINIBATCH = 1500, 8, 0.004, 16
#: The score where the labels tell nothing: undecided, which keeps a document.
NO_EVIDENCE = 0.5

Weights = dict[str, np.ndarray]


def blocks(text: bytes) -> np.ndarray:
    """The text's bytes in rows of STEP, with empty bytes up to two rows and to the last row's end."""
    n = max(2, -(-len(text) // STEP))
    return np.frombuffer(text.ljust(n * STEP, b"\0"), np.uint8).reshape(n, STEP)


def answers(w: Weights, rows: np.ndarray) -> np.ndarray:
    """(windows, FILTERS): each filter's answer at each step."""
    x = w["bytes"][rows].reshape(len(rows), STEP * DIM)
    y = x @ w["halves"]
    return np.maximum(y[:-1, :FILTERS] + y[1:, FILTERS:] + w["bias"], 0)


def chunk_starts(windows: int) -> np.ndarray:
    """Starts of the chunks over so many windows; the last one ends with them."""
    return np.arange(0, max(1, windows - (CHUNK - STRIDE)), STRIDE)


def pooled(w: Weights, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum over chunks, maximum over chunks, chunks) of the max-pooled answers, slice by slice."""
    rows = blocks(text)
    starts = chunk_starts(len(rows) - 1)
    total, most = np.zeros(FILTERS), np.zeros(FILTERS)
    per = max(1, SLICE // (STRIDE * STEP))
    for i in range(0, len(starts), per):
        some = starts[i : i + per]
        low, high = some[0], min(len(rows), some[-1] + CHUNK + 1)
        a = answers(w, rows[low:high])
        a = np.concatenate([a, a[-1:]])  # reduceat wants each end inside
        ends = np.minimum(some - low + CHUNK, len(a) - 1)
        top = np.maximum.reduceat(a, np.stack([some - low, ends], 1).ravel(), axis=0)[::2]
        total += top.sum(axis=0)
        most = np.maximum(most, top.max(axis=0))
    return total, most, len(starts)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(w: Weights, text: bytes) -> float:
    """The probability of label 1, over the whole text."""
    total, most, n = pooled(w, text)
    return float(_sigmoid(np.concatenate([total / n, most]) @ w["out"] + w["base"][0]))


def start(seed: int) -> Weights:
    r = np.random.default_rng(seed)
    return {"bytes": r.normal(0, 0.5, (256, DIM)).astype(np.float32), "halves": r.normal(0, 0.25, (STEP * DIM, 2 * FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "base": np.zeros(1, np.float32)}


def gradient(w: Weights, text: bytes, label: int, weight: float, into: Weights) -> float:
    """Adds the gradient of weight * log loss of one document to `into`; its score."""
    rows = blocks(text)
    a = answers(w, rows)
    starts = chunk_starts(len(a))
    at = np.minimum(starts[:, None] + np.arange(CHUNK)[None, :], len(a) - 1)
    best = np.take_along_axis(at[:, :, None].repeat(FILTERS, 2), a[at].argmax(axis=1)[:, None, :], 1)[:, 0, :]  # (chunks, FILTERS)
    top = np.take_along_axis(a, best, 0)
    lead = top.argmax(axis=0)
    features = np.concatenate([top.mean(axis=0), top.max(axis=0)])
    p = float(_sigmoid(features @ w["out"] + w["base"][0]))
    error = weight * (p - label)
    into["out"] += error * features
    into["base"] += error
    back = np.repeat(error * w["out"][None, :FILTERS] / len(top), len(top), 0)
    back[lead, np.arange(FILTERS)] += error * w["out"][FILTERS:]
    back *= top > 0
    into["bias"] += back.sum(axis=0)
    x = w["bytes"][rows].reshape(len(rows), STEP * DIM)
    for half, shift in ((0, 0), (1, 1)):
        where = np.minimum(best + shift, len(rows) - 1)
        columns = slice(half * FILTERS, (half + 1) * FILTERS)
        into["halves"][:, columns] += np.einsum("cf,cfd->df", back, x[where])
        deep = (back[:, :, None] * w["halves"][:, columns].T[None, :, :]).reshape(-1, STEP, DIM)
        np.add.at(into["bytes"], rows[where.ravel()].ravel(), deep.reshape(-1, DIM))
    return p


def fit(labelled: list[tuple[str, int]], seed: int = 8) -> Weights:
    """Weights from (text, 0 or 1), by Adam; both classes weigh the same. No rows: the untrained network."""
    w, r = start(seed), np.random.default_rng(seed)
    documents = [(t.encode(), y) for t, y in labelled]
    positives = sum(y for _, y in documents)
    balance = {1: 0.5 * len(documents) / max(positives, 1), 0: 0.5 * len(documents) / max(len(documents) - positives, 1)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    steps = 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(documents))
        for i in range(0, len(order), MINIBATCH):
            g = {k: np.zeros_like(v) for k, v in w.items()}
            for k in order[i : i + MINIBATCH]:
                gradient(w, *documents[k], balance[documents[k][1]] / MINIBATCH, g)
            steps += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for k in w:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return w


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """text -> score, learnt from labels (doc_id, quality) of rows whose crc32(doc_id as text) mod 3 is not 1.

    Without rows of both labels there is no evidence against any text: all score NO_EVIDENCE.
    """
    labelled = training_rows(docs, labels, "quality", 3, 1, sample)
    if no_evidence([y for _, y in labelled]):
        return lambda text: NO_EVIDENCE
    held = docs.sparkSession.sparkContext.broadcast(fit(labelled))  # a few thousand numbers
    return lambda text: score(held.value, (text or "").encode())


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, quality, ...): (doc_id, held_out, score, predicted), a row for each row.

    Null and empty texts are scored as bytes of padding. Rows that repeat a doc_id, or have none (never held out), are
    scored each for itself; of labels that repeat a doc_id one counts, those without 0 or 1 do not. Labels of one kind, or
    none, are no evidence: every score is NO_EVIDENCE, and every document passes. Nothing but the text enters a score. An empty table gives an empty one.
    """
    return score_documents(docs, quality_model(docs, labels), 3, 1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
