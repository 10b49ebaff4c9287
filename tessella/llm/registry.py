"""The queries of the corpus operators, one each, and the pipeline over them.

None of these can be put in SQL as a whole (trained models, tokenisers, Luhn sums, components over signatures), so none has
an oracle; tests/llm holds each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_bpe
from .codes import op12_codes
from .fingerprint import op2_fingerprint
from .guesses import op13_secrets
from .minhash import op7_minhash
from .packing import op10_packing
from .pii import op3_pii
from .quality import op8_quality
from .substring import op9_substring
from .toxicity import op5_toxicity
from .urls import op1_urls
from .vectors import op4_vectors
from .whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_urls, op2_fingerprint, op3_pii, op4_vectors, op5_toxicity, op6_bpe, op7_minhash, op8_quality, op9_substring, op10_packing, op11_whitening, op12_codes, op13_secrets)}


def oracle_sql() -> dict[str, str]:
    return {}
