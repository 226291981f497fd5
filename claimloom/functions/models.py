"""Adapters for trained models, with deterministic defaults that need none.

A scorer is a function of two text columns. A model of one's own is loaded once for each worker, inside the function.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

SIZE = 256
#: Texts that a model gets at once, however many a batch brings.
TEXTS = 256


def hashed_vector(text: str | None, size: int = SIZE) -> np.ndarray:
    """Counts of lower-cased words by hash, of length 1 if there are any."""
    v = np.zeros(size, np.float32)
    for w in (text or "").lower().split():
        v[zlib.crc32(w.encode("utf-8", "replace")) % size] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None):
    """A column function text -> vector. load: returns a function from texts to a matrix; by default hashed words."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load() if load else lambda texts: np.array([hashed_vector(t) for t in texts]).reshape(-1, SIZE)
        for texts in batches:
            for k in range(0, len(texts), TEXTS):
                yield pd.Series(list(run(texts.iloc[k : k + TEXTS].tolist())))

    return encode


def scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]] | None = None):
    """A column function (text, text) -> probability; by default the cosine of hashed words."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = load() if load else lambda a, b: np.array([float(hashed_vector(x) @ hashed_vector(y)) for x, y in zip(a, b, strict=True)])
        for a, b in batches:
            for k in range(0, len(a), TEXTS):
                yield pd.Series(run(a.iloc[k : k + TEXTS].tolist(), b.iloc[k : k + TEXTS].tolist()), dtype=float)

    return score


def entailment(premise: Column, hypothesis: Column) -> Column:
    return scorer()(premise, hypothesis)
