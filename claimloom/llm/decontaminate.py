"""Benchmark passages in documents, by Wu-Manber search over words.

A symbol is a word. For each pattern length there is a shift table by hashed blocks of two words, which tells how far the
search may jump, and buckets by the last block, whose patterns are compared directly. All items' words are held once, as
numbers in one array; a pattern is a place in it, so the tables take some 40 bytes a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, put

#: A-Z to lower case; all other ASCII characters but 0-9 and a-z divide words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Windows that one broadcast may hold (some 85 MB); a larger benchmark is searched in several passes.
BROADCAST_WINDOWS = 2_000_000

FOUND = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>>"


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode("utf-8", "replace") if isinstance(text, str) else text).translate(FOLD).split()


#: Spreads the first word of a block over the shift table; small, so that products stay short integers.
SPREAD = 40503


class WuManber:
    """Patterns of one length: the windows that begin at these places of the items' words."""

    def __init__(self, length: int, words: np.ndarray, places: np.ndarray, items: np.ndarray, base: int):
        self.m, self.words, self.base = length, words, base
        self.block = min(2, length)
        self.most = length - self.block + 1
        bits = int(len(places)).bit_length()  # a megabyte, or 16 to 32 bytes a window
        self.mask = (1 << max(10, min(bits + 6, 20), min(bits + 4, 24))) - 1
        shift = np.full(self.mask + 1, min(self.most, 255), np.uint8)
        for end in range(self.block, length + 1):  # the last ones have the least shift
            first = self.words[places + end - 2].astype(np.int64) if self.block == 2 else 0
            slot = (first * SPREAD + self.words[places + end - 1]) & self.mask
            np.minimum.at(shift, slot, np.uint8(min(length - end, 255)))
        self.shift = shift.tobytes()
        last = self.keys(places + length)
        order = np.argsort(last, kind="stable")
        self.last, self.places, self.items = last[order], places[order], items[order]

    def keys(self, ends: np.ndarray) -> np.ndarray:
        """The blocks before these places, as numbers."""
        k = self.words[ends - 1].astype(np.uint64)
        return self.words[ends - 2].astype(np.uint64) * np.uint64(self.base) + k if self.block == 2 else k

    def search(self, words: list[bytes], ids: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
        """First word of each occurrence, and the numbers of the items it belongs to. ids: the numbers of the items' words."""
        m, n, shift, mask, pair, number = self.m, len(words), self.shift, self.mask, self.block == 2, ids.get
        at = m - 1
        while at < n:
            last = number(words[at], 0)
            if not last:  # no window holds this word
                at += m
                continue
            first = number(words[at - 1], 0) if pair else 0
            jump = shift[(first * SPREAD + last) & mask]
            if jump:
                at += jump
                continue
            key = np.uint64(first * self.base + last if pair else last)
            lo = self.last.searchsorted(key)
            if lo < len(self.last) and self.last[lo] == key:
                hi = self.last.searchsorted(key, side="right")
                window, hits = [number(w, 0) for w in words[at - m + 1 : at + 1]], []
                for i in range(lo, hi, 4096):
                    same = np.arange(i, min(i + 4096, hi))
                    for j in range(m - self.block - 1, -1, -1):
                        same = same[self.words[self.places[same] + j] == window[j]]
                        if not len(same):
                            break
                    hits.append(self.items[same])
                hit = np.concatenate(hits)
                if len(hit):
                    yield at - m + 1, hit
            at += 1


class Searchers:
    """A Wu-Manber search for each pattern length: items of fewer words than a window are one pattern."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.ids: dict[bytes, int] = {}
        stream: list[np.ndarray] = []
        by: dict[int, list[tuple[int, int, int]]] = {}  # length: (first place, windows, item)
        at = 0
        for name, text in items:
            w = words_of(text)
            n = min(window, len(w))
            if n:
                by.setdefault(n, []).append((at, len(w) - n + 1, number[name]))
                stream.append(np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int32))
                at += len(w)
        words = np.concatenate(stream) if stream else np.empty(0, np.int32)
        self.each = []
        for n, runs in sorted(by.items()):
            places = np.concatenate([np.arange(a, a + k) for a, k, _ in runs])
            self.each.append(WuManber(n, words, places, np.repeat([i for *_, i in runs], [k for _, k, _ in runs]).astype(np.int32), len(self.ids) + 1))

    def scan(self, text: str | None, known=(), known_items=()) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged spans of hit words (end exclusive), items found; with those known from other searchers."""
        words = words_of(text)
        spans, found = [(s["start"], s["stop"]) for s in known], set()
        for s in self.each:
            for at, items in s.search(words, self.ids):
                spans.append((at, at + s.m))
                found.update(items.tolist())
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return len(words), [(a, b) for a, b in merged], sorted({self.names[i] for i in found}.union(known_items))


def build(items: list[tuple[str, str]], window: int) -> Searchers:
    return Searchers(items, window)


def scan(text: str | None, searchers: Searchers) -> tuple[int, list[tuple[int, int]], list[str]]:
    return searchers.scan(text)


def _rows(found: Iterator[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(n, sum(b - a for a, b in spans), [{"start": a, "stop": b} for a, b in spans], items) for n, spans, items in found], columns=["n_words", "n_hit", "spans", "items"])


def _finder(held, more: bool):
    """A function of the text, and of the spans and items of earlier passes. The tables are made once, on the driver."""

    @F.pandas_udf(FOUND)
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _rows(map(held.value.scan, texts))

    @F.pandas_udf(FOUND)
    def further(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans, items in batches:
            yield _rows(map(held.value.scan, texts, spans, items))

    return further("text", "found.spans", "found.items") if more else first("text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with ``found``: n_words, n_hit (words inside an occurrence), spans of hit words and items found.

    Words: A-Z lower-cased, divided by ASCII characters that are neither digits nor letters. A null or empty text has
    no words. An item of fewer words than a window is one window; one without words, or with null text, matches
    nothing. Equal windows count for all their items; a null item_id is the item "null". An empty benchmark finds
    nothing. The searchers are broadcast while the benchmark has at most ``most`` windows; a larger one is searched in
    passes, each written to the shared folder. A column named found is replaced.
    """
    spark = docs.sparkSession
    parts = list(_split(benchmark, most, window))
    out, stash, tables = put(docs, {"found": F.lit(None).cast(FOUND)}), None, []
    for k, part in enumerate(parts):
        held = spark.sparkContext.broadcast(build(part(), window))
        out = put(out, {"found": _finder(held, k > 0)})
        if len(parts) > 1:
            stash = stash or Stash(spark)
            out = stash(out)
            held.unpersist()
            if k:
                stash.drop(tables.pop())
            tables.append(out)
    return out


def _split(benchmark: DataFrame, most: int, window: int):
    """Functions that give the (item, text) rows of each pass: of one, all; of several, those whose text's hash is theirs."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text IS NOT NULL")
    windows = F.greatest(F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")) - (window - 1), F.lit(1))
    size = rows.agg(F.coalesce(F.sum(windows), F.lit(0))).first()[0]
    n = int(-(-size // (most // 2 if size > most else most))) or 1
    return [lambda i=i: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()] for i in range(n)]
