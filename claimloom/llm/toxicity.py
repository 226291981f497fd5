"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned from the labelled texts: whole words and word beginnings that toxic texts hold far more often.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Stash, free_name, put
from .gbt import BoostedTrees, Isotonic

#: Most labelled rows of each class that are fitted on.
FIT_ROWS = {0: 5000, 1: 3000}
#: Second person, in the languages of the corpus (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
#: Characters that stand for letters inside a word (fixed values).
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
#: Letters with a stand-in or a divider between them: b4d, st*pid, s.c.u.m
MASKED = re.compile(r"[^\W\d_]+(?:[0134578@$!*.\-_]+[^\W\d_]+)+")
ENTRY_ENDS = (4, 5, 6, 7)
FEATURES = ("hits", "hit_rate", "kinds", "weight_rate", "best", "near_second", "second_rate", "capital_rate", "shouted_rate", "exclaim_rate", "question_rate", "mark_rate", "masked_rate", "masked_hits", "log_words")


def entries(words: set[str]) -> set[str]:
    """What a lexicon entry may be: a word, or the beginning of longer words, written with a star."""
    return {f"{w[:k]}*" for w in words for k in ENTRY_ENDS if len(w) > k} | words


#: Texts of label 1 that an entry must be in, and its least test value.
LEAST_TEXTS, LEAST_TEST = 6, 20.0


def learn_lexicon(seen: list[tuple[str, int, int]], n: tuple[int, int]) -> dict[str, float]:
    """Entries with a weight (log odds), strongest first; an entry that another one covers is left out.

    seen: (entry, texts of label 1 with it, texts of label 0 with it); n: texts of label 0 and of label 1.
    """
    n = (max(1, n[0]), max(1, n[1]))
    base = n[1] / sum(n)
    scored = []
    for e, t, c in seen:
        if t < LEAST_TEXTS or t / (t + c) < 0.5 + base / 2:
            continue
        test = 2 * (t * math.log(t / ((t + c) * base)) + (c * math.log(c / ((t + c) * (1 - base))) if c else 0))
        if test > LEAST_TEST:
            scored.append((-test, -len(e), e, t, math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))))
    out: dict[str, float] = {}
    longer: dict[str, int] = {}  # texts of the commonest chosen entry that goes on after this beginning
    for _, _, e, t, weight in sorted(scored):
        stem = e.rstrip("*")
        begins = [stem[:k] for k in ENTRY_ENDS if k <= len(stem)]
        if t >= 1.3 * longer.get(stem, 0) and not any(f"{b}*" in out for b in begins):
            out[e] = weight
            for b in begins:
                longer[b] = max(longer.get(b, 0), t)
    return out


def least_hashes(text: str) -> list[int]:
    """The least of three hashes over the text's 3-word shingles."""
    factor = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    w, out = text.split(), np.full(3, np.iinfo(np.uint64).max)
    for i in range(0, max(1, len(w) - 2), 1 << 16):
        h = np.array([hash_of(" ".join(w[j : j + 3])) for j in range(i, min(i + (1 << 16), max(1, len(w) - 2)))], np.uint64) + np.uint64(1)
        out = np.minimum(out, ((h[:, None] * factor) >> np.uint64(20)).min(0))
    return out.astype(np.int64).tolist()


def one_of_each(least: list[list[int]]) -> np.ndarray:
    """False for texts that share one of their least hashes with an earlier one: near copies."""
    seen: list[set[int]] = [set(), set(), set()]
    out = np.ones(len(least), bool)
    for i, row in enumerate(least):
        out[i] = not any(v in s for v, s in zip(row, seen, strict=True))
        for v, s in zip(row, seen, strict=True):
            s.add(v)
    return out


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.words = {e: w for e, w in lexicon.items() if not e.endswith("*")}
        self.starts = {e[:-1]: (e, w) for e, w in lexicon.items() if e.endswith("*")}
        self.memo: dict[str, tuple[str, float] | None] = {}

    def find(self, word: str) -> tuple[str, float] | None:
        if word in self.words:
            return word, self.words[word]
        for k in ENTRY_ENDS:
            if len(word) > k and word[:k] in self.starts:
                return self.starts[word[:k]]
        return None

    def row(self, text: str | None) -> list[float]:
        text = text or ""
        words = WORD.findall(text)
        lower = WORD.findall(text.lower())
        n = max(1, len(lower))
        if len(self.memo) > 300_000:
            self.memo.clear()
        memo, near = self.memo, 0
        for w in set(lower).difference(memo):
            memo[w] = self.find(w)
        at = [i for i, w in enumerate(lower) if memo[w]]
        hits = [memo[lower[i]] for i in at]
        you = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
        if at and you:
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(np.take(you, np.minimum(k, len(you) - 1)) - at), np.abs(np.take(you, np.maximum(k - 1, 0)) - at))
            near = int((gap <= 3).sum())
        masked = MASKED.findall(text) if re.search(r"\w[0134578@$!*.\-_]+\w", text) else []
        bare = [re.sub(r"[^\w]|_", "", m.lower().translate(LEET)) for m in masked]
        masked_hits = sum(self.find(b) is not None or self.masked_word(m.lower()) for b, m in zip(bare, masked, strict=True))
        size = max(1, len(text))
        caps = sum(1 for w in words if w[0].isupper())
        shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
        return [
            math.log1p(len(hits)), len(hits) / n, len({e for e, _ in hits}), sum(w for _, w in hits) / n, max([0.0, *(w for _, w in hits)]),
            near / n, len(you) / n, caps / n, shouted / n, text.count("!") / size, text.count("?") / size,
            sum(map(text.count, ".,;:*#%&$|")) / size, len(masked) / n, masked_hits, math.log1p(len(lower)),
        ]

    def masked_word(self, word: str) -> bool:
        """Stars and the like stand for one letter each: does an entry fit?"""
        if not re.search(r"[*\-_.]", word) or len(word) < 4 or not word[0].isalpha():
            return False
        plain = word.translate(LEET)
        fits = lambda e: all(c in "*-_." or c == x for c, x in zip(plain, e, strict=False))
        return any(len(e) == len(plain) and fits(e) for e in self.words) or any(len(e) < len(plain) and fits(e) for e in self.starts)

    def matrix(self, texts) -> np.ndarray:
        return np.array([self.row(t) for t in texts], float).reshape(-1, len(FEATURES))


class Model:
    """Trees and calibration, fitted on two thirds and one third of the labelled rows."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, weight: np.ndarray, fit: np.ndarray):
        self.lexicon, self.trees = lexicon, None
        self.rate = float(np.average(y, weights=weight)) if len(y) else 0.0
        if len(x):
            self.trees = BoostedTrees(trees=60, depth=3).fit(x[fit], y[fit], weight[fit])
            self.scale = Isotonic().fit(self.trees.raw(x[~fit]), y[~fit], weight[~fit])

    def scores(self, f: Featurizer, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), min(self.rate, 0.49))
        return np.clip(self.scale.predict(self.trees.raw(f.matrix(texts))), 0, 1)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry, t, c) of each batch: texts of label 1 and 0 with the entry."""
    for df in batches:
        seen: list[Counter[str]] = [Counter(), Counter()]
        for text, label in zip(df["text"], df["toxic"], strict=True):
            seen[label].update(entries(set(WORD.findall(text.lower()))))
        all_ = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"entry": all_, "t": [seen[1][e] for e in all_], "c": [seen[0][e] for e in all_]})


def _marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield pd.DataFrame({"h": df["h"], "toxic": df["toxic"], "crc": [hash_of(t) for t in df["text"]], "least": [least_hashes(t) for t in df["text"]]})


def fit_model(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> Model:
    """A model from documents and their labels (doc_id, toxic): at most ``rows`` of each class, spread by a hash.

    Rows with a null id, text or label, or a label other than 0 and 1, are not fitted on; of several labels for an id the
    largest counts, equal texts count once. With fewer than 20 rows or one class only, every text scores the rate of label
    1, below one half. Words are counted and features are made where the texts are: the driver gets hashes, the entries
    that pass the tests, and a row of features for each text.
    """
    rows, (key,) = rows or FIT_ROWS, free_name(docs, "labelled_id")
    stash = Stash(docs.sparkSession)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.max("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    n = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    ids = None
    for k in (0, 1):
        some = marks.where(F.col("toxic") == k).orderBy(F.xxhash64(key, F.lit(5)), key).limit(rows[k])
        ids = some if ids is None else ids.unionByName(some)
    mine = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col(key))  # the sum of rows ids at most
    texts = stash(mine.select("text", F.xxhash64("text").alias("h"), "toxic").dropDuplicates(["h", "toxic"]))
    told = sorted(texts.mapInPandas(_marked, "h bigint, toxic int, crc bigint, least array<bigint>").collect(), key=lambda r: (r.crc, r.h, r.toxic))
    y = np.array([r.toxic for r in told], np.int64)
    weight = np.array([n.get(k, 0) / max(1, int((y == k).sum())) for k in y.tolist()])
    weight = weight / weight.mean() if len(weight) else weight
    fit = np.arange(len(y)) % 3 != 0
    none = np.zeros((0, len(FEATURES)))
    if len(y) < 20 or not 0 < y.sum() < len(y):
        return Model({}, none, y, weight, fit)
    new = one_of_each([r.least for r in told]) & fit  # else chance words of a copied text would look like a lexicon
    chosen = docs.sparkSession.createDataFrame([(r.h, r.toxic) for r, ok in zip(told, new, strict=True) if ok], "h long, toxic int")
    seen = texts.join(F.broadcast(chosen), ["h", "toxic"], "left_semi").select("text", "toxic").mapInPandas(_counted, "entry string, t bigint, c bigint")
    base = int(y[new].sum()) / max(1, int(new.sum()))
    seen = seen.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where((F.col("t") >= LEAST_TEXTS) & (F.col("t") / (F.col("t") + F.col("c")) >= 0.5 + base / 2 - 1e-9))
    lexicon = learn_lexicon([tuple(r) for r in seen.collect()], (int((y[new] == 0).sum()), int(y[new].sum())))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Featurizer(lexicon)
        for df in batches:
            yield pd.DataFrame({"h": df["h"], "toxic": df["toxic"], "x": list(f.matrix(df["text"]))})

    made = {(r.h, r.toxic): r.x for r in texts.mapInPandas(featured, "h bigint, toxic int, x array<double>").collect()}
    stash.drop(texts)
    return Model(lexicon, np.array([made[r.h, r.toxic] for r in told]), y, weight, fit)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), from the text alone. Null and empty texts are scored as texts without words.

    Equal texts get equal scores. An empty table gives an empty result. A column named toxicity is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # some hundred lexicon entries and 60 small trees

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m: Any = held.value
        f = Featurizer(m.lexicon)
        for texts in batches:
            yield pd.Series(m.scores(f, texts))

    return put(docs, {"toxicity": score(F.col("text"))})
