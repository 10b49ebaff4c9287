"""Embedders: functions of a text column that give a column of vectors, one a row and in the rows' order.

Any model fits behind Callable[[Column], Column]; the one here needs none. Blank texts have an empty vector, others one of
unit length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]

_terms = regex.compile(r"[\p{L}\p{N}_]{2,}")


@lru_cache(100_000)
def slot(term: str, width: int) -> int:
    """The component that a term counts in."""
    return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % width


def embed(text: str | None, width: int) -> list[float]:
    """Hashed term counts at unit length; empty for blank texts, zeros for texts without terms."""
    if not text or not text.strip():
        return []
    out = np.bincount([slot(t, width) for t in _terms.findall(text.lower())], minlength=width).astype(np.float64)
    return (out / (np.sqrt(out @ out) or 1.0)).tolist()


def hash_embedder(width: int = 64) -> Embedder:
    return F.pandas_udf(lambda texts: pd.Series([embed(t, width) for t in texts], dtype=object), "array<double>")
