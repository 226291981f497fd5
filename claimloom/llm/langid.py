"""Language of a text by a string kernel: presence of character n-grams of 1 to 3 symbols (blended spectrum).

K(x, y) = |S(x) & S(y)| / sqrt(|S(x)| |S(y)|), S being the set of n-grams. Ridge regression, one language against the
rest, is solved on Nystroem landmarks. As the kernel is an inner product of presence vectors, the landmarks' weights
fold into one weight for each of their n-grams and each language, and a batch of texts is scored by the product of its
presence matrix and those weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import put

#: Most rows that are fitted on: for each language, and in all (one for each language at least).
FIT_ROWS, FIT_TOTAL = 400, 8000
#: Landmarks, or two for each language if that is more.
LANDMARKS = 256
#: Languages whose weights are broadcast and multiplied at once; more are scored in several passes.
LANG_BLOCK = 64
RIDGE = 1e-3
SYMBOLS = 64
#: All n-grams of 1 to 3 symbols.
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


@lru_cache(1)
def symbol_of() -> np.ndarray:
    """Symbol of each code point: 0 if no letter, 1 to 26 for a to z, else one of 37 by the code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return table


def grams(text: str | None) -> np.ndarray:
    """Ids of the n-grams that the text has, in rising order; a run of other characters than letters is one symbol."""
    if not text:
        return np.empty(0, np.int32)
    s = symbol_of()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.int32)
    s = np.r_[0, s, 0]
    s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]]
    seen = np.zeros(GRAMS, bool)
    seen[s] = True
    seen[SYMBOLS + s[:-1] * SYMBOLS + s[1:]] = True
    seen[SYMBOLS + SYMBOLS**2 + (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]] = True
    return np.flatnonzero(seen).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Weights of n-grams (``columns``, rising) for languages."""

    def __init__(self, langs: list[str], columns: np.ndarray, weights: np.ndarray):
        self.langs, self.columns, self.weights = langs, columns, weights

    @staticmethod
    def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        names = sorted(set(langs))
        if not names:
            return Model([], np.empty(0, np.int32), np.zeros((0, 0), np.float32))
        # landmarks: the first rows of each language in turn (rows come in the order of a hash)
        turn = {}
        order = sorted(range(len(sets)), key=lambda i: (turn.setdefault(langs[i], []).append(i) or len(turn[langs[i]]), langs[i]))
        chosen = order[:landmarks]
        columns = np.unique(np.concatenate([sets[i] for i in chosen]))
        at = np.full(GRAMS, -1, np.int32)
        at[columns] = np.arange(len(columns))
        norm = lambda ids: 1 / np.sqrt(np.maximum(1, [len(sets[i]) for i in ids]))[:, None]
        base = present([sets[i] for i in chosen], at, len(columns)) * norm(chosen).astype(np.float32)
        parts = [range(i, min(i + 128, len(sets))) for i in range(0, len(sets), 128)]
        k_nm = np.concatenate([present([sets[i] for i in ids], at, len(columns)) @ base.T * norm(ids) for ids in parts]).astype(float)
        y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
        k_mm = (base @ base.T).astype(float)
        left = k_nm.T @ k_nm + ridge * len(sets) * k_mm + 1e-6 * np.eye(len(chosen))
        w = np.linalg.solve(left, k_nm.T @ y)
        return Model(names, columns, (base.T @ w).astype(np.float32))

    def blocks(self, size: int = LANG_BLOCK) -> list[Model]:
        """Models of ``size`` languages at most."""
        return [Model(self.langs[i : i + size], self.columns, self.weights[:, i : i + size]) for i in range(0, len(self.langs), size)]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and value of each text: the largest product, which nears 1 for the language and -1 for others."""
        lang, value = ["und"] * len(texts), np.full(len(texts), -np.inf)
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.langs or not known:
            return lang, value
        if not hasattr(self, "at"):
            self.at = np.full(GRAMS, -1, np.int32)
            self.at[self.columns] = np.arange(len(self.columns))
        for a in range(0, len(known), 128):
            part = known[a : a + 128]
            sets = [grams(texts[i]) for i in part]
            product = (present(sets, self.at, len(self.columns)) @ self.weights) / np.sqrt([len(s) for s in sets])[:, None]
            best = product.argmax(1)
            value[part] = product[np.arange(len(part)), best]
            for i, b in zip(part, best, strict=True):
                lang[i] = self.langs[b]
        return lang, value


def present(sets: list[np.ndarray], at: np.ndarray, columns: int) -> np.ndarray:
    """A row of zeros and ones for each set of n-grams; at: the column of each n-gram, or -1."""
    out = np.zeros((len(sets), columns), np.float32)
    for row, s in zip(out, sets, strict=True):
        c = at[s]
        row[c[c >= 0]] = 1
    return out


def fit_model(docs: DataFrame, per_lang: int = FIT_ROWS, total: int = FIT_TOTAL) -> Model:
    """A model from the (doc_id, text, lang) rows: at most ``per_lang`` different texts of each language, by a hash.

    Rows with a null language and texts without a letter are not fitted on; every other language is learned. The driver
    gets n-gram ids of the sample, not its texts.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    if not n:
        return Model.fit([], [])
    each = max(1, min(per_lang, total // len(n)))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    share = docs.sparkSession.createDataFrame([(k, min(1.0, (2.0 * each + 20) / c)) for k, c in n.items()], "sample_lang string, share double")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"lang": df["lang"], "h": df["h"], "grams": [grams(t).tobytes() for t in df["text"]]})

    sample = usable.select("text", "lang", F.xxhash64("text", F.lit(4)).alias("h"), part.alias("part")).join(F.broadcast(share), F.col("lang") == F.col("sample_lang"))
    sample = sample.where("part <= share").select("text", "lang", "h").distinct().mapInPandas(sets, "lang string, h bigint, grams binary")
    first = sample.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    chosen = sorted(first.select("lang", "h", "grams").collect(), key=lambda r: (r.h, r.lang))
    return Model.fit([np.frombuffer(r.grams, np.int32) for r in chosen], [r.lang for r in chosen], max(LANDMARKS, 2 * len(n)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1), from the whole text alone.

    A null text, and one without a letter, is "und" with score 0; so is every text if nothing could be learned. An empty
    table gives an empty result. Columns of these names are replaced.
    """
    found = put(docs, {"lang_score": _best(docs.sparkSession, model.blocks() or [model])})
    known = F.col("lang_score")["value"].isNotNull()
    score = F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("lang_score")["value"] + 1) / 2))).otherwise(0.0)
    return put(found, {"lang_pred": F.col("lang_score")["lang"], "lang_score": score})


def _best(spark, models: list[Model]):
    """The (value, place, lang) of the best block; a block's weights are some n-grams times LANG_BLOCK floats."""

    def predictor(held, place: int):
        @F.pandas_udf("value double, place int, lang string")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                lang, value = held.value.predict(texts.tolist())
                yield pd.DataFrame({"value": pd.Series(value).where(np.isfinite(value)), "place": place, "lang": lang})

        return predict(F.col("text"))

    each = [predictor(spark.sparkContext.broadcast(m), -k) for k, m in enumerate(models)]
    return each[0] if len(each) == 1 else F.greatest(*each)
