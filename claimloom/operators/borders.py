"""Sentence borders from tokens, with abbreviations and sentence starters learned from the corpus.

A stop after a word may end a sentence or belong to the word. Words that have a stop after them nearly always, and more
often than stops occur at all, are abbreviations: a log-likelihood ratio over two counts a word, weighted by its length and
its own stops, says so. Words that follow sure borders more often than chance are starters; after an abbreviation only
they begin a sentence. Both come from counts by word, in two aggregates over the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import Numbered, Tokenizer
from ..session import Stash

#: Score from which a word is an abbreviation, log-likelihood from which one is a starter (values of the published method).
ABBREVIATION, STARTER = 0.3, 30.0
#: Words and starters that a model may hold: it goes to every task.
MOST_WORDS = 500_000
#: Words that a task counts before it hands them on.
COUNTED = 300_000

ENDS = {".", "!", "?", "…", "。", "！", "？"}
#: Last letters of the tokens that may end a sentence: marks and white space.
_LAST = {*ENDS, *filter(str.isspace, map(chr, range(0x3001)))}
CLOSERS = set(")]}\"'”’»」』")
_WORD = re.compile(r"[^\W_]")
_NUMBER = re.compile(r"[+-]?\d[\d.,]*")
_INITIAL = re.compile(r"[^\W\d_]")


def may_end(token: str) -> bool:
    return token[-1] in _LAST


@dataclass(frozen=True)
class Borders:
    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()
    #: whether a line end ends a sentence; a blank line always does
    lines: bool = True

    def numbers(self, tokens: list[str], spaces: list[bool]) -> list[int]:
        """For each token the number of its sentence, from 0. Closing marks stay with the sentence before them."""
        begins = self.firsts(tokens, spaces, [i for i, t in enumerate(tokens) if may_end(t)])
        out: list[int] = []
        for k, (a, b) in enumerate(pairwise([0, *begins, len(tokens)])):
            out += [k] * (b - a)
        return out

    def firsts(self, tokens: list[str], spaces: list[bool], marks: Iterable[int]) -> list[int]:
        """Where sentences begin, but for the first one. marks: the places of all tokens that may end a sentence."""
        n, begins = len(tokens), []
        for i in marks:
            if begins and begins[-1] > i:
                continue  # the sentence is over already
            t = tokens[i]
            if t.isspace():
                breaks = t.count("\n")
                over = breaks > 1 or (self.lines and breaks > 0)
            else:
                over = (t in ENDS or (len(t) > 1 and t[-1] == "." and (t[0] == "." or _WORD.match(t) is not None))) and self.ends(tokens, spaces, i, n)
            if over:
                j = i + 1
                while j < n and (tokens[j] in CLOSERS or tokens[j] in ENDS or tokens[j].isspace()):
                    j += 1
                if j == n:
                    break
                begins.append(j)
        # a border before the first word is none
        if begins and all(t.isspace() for t in tokens[: begins[0]]):
            del begins[0]
        return begins

    def ends(self, tokens: list[str], spaces: list[bool], i: int, n: int) -> bool:
        """Whether the sentence is over after the mark at i."""
        t = tokens[i]
        if t in ENDS and t not in (".", "…"):
            return True
        j = i + 1
        while j < n and (tokens[j] in CLOSERS or tokens[j] in ENDS):
            j += 1
        if j == n or tokens[j].isspace():
            return j == n or "\n" in tokens[j] or j + 1 >= n or self.begins(tokens, i, tokens[j + 1], t)
        if j == i + 1 and not spaces[i]:
            return False  # something stands right after the stop
        return self.begins(tokens, i, tokens[j], t)

    def begins(self, tokens: list[str], i: int, after: str, mark: str) -> bool:
        if after[0].islower():
            return False
        word = tokens[i - 1] if mark == "." and i else mark[:-1] if mark[-1] == "." and mark[0] != "." else ""
        if not word:
            return True
        low = word.lower()
        if _NUMBER.fullmatch(word) and not (after[0].isupper() or not after[0].isalnum()):
            return False  # an ordinal or a list's number before another number
        if mark != "." or low in self.abbreviations or _INITIAL.fullmatch(word):  # a stop of its own is an abbreviation's
            return after.lower() in self.starters
        return True


def later_sentences(texts: Numbered, borders: Borders) -> list[list[int]]:
    """At which of its tokens each text's second and later sentences begin."""
    ending = np.zeros(len(texts.names), bool)
    ending[texts.odd] = [may_end(texts.names[k]) for k in texts.odd.tolist()]
    marks, ends = np.flatnonzero(ending[texts.numbers]), [0, *np.cumsum(texts.n).tolist()]
    tokens, spaces, parts = [*map(texts.names.__getitem__, texts.numbers.tolist())], texts.spaces.tolist(), np.searchsorted(marks, ends).tolist()
    return [borders.firsts(tokens[a:b], spaces[a:b], (marks[i:j] - a).tolist()) for (a, b), (i, j) in zip(pairwise(ends), pairwise(parts), strict=True)]


def _counted(docs: DataFrame, tokenizer: Tokenizer, count, columns: str) -> DataFrame:
    """Rows (word, ...) of ``count``: tokens, spaces to an iterator of (word, which count); summed by word."""
    names = columns.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = sorted({w for w, _ in counts})
            made = [pa.array(words, pa.string()), *(pa.array([counts[w, k] for w in words], pa.int64()) for k in range(len(names)))]
            counts.clear()
            return pa.RecordBatch.from_arrays(made, ["word", *names])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    tokens, _, spaces = tokenizer(text)
                    counts.update(count(tokens, spaces))
            if len(counts) > COUNTED:
                yield rows()
        yield rows()

    made = docs.select("text").mapInArrow(run, "word string, " + ", ".join(f"{n} bigint" for n in names))
    return made.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def words_and_stops(tokens: list[str], spaces: list[bool]) -> Iterator[tuple[str, int]]:
    """(word, 0) for each word, (word, 1) if a stop follows it without a blank; words in lower case, without own last stop."""
    for i, t in enumerate(tokens):
        if _WORD.search(t) and not _NUMBER.fullmatch(t):
            low = t.lower()
            own = len(low) > 1 and low[-1] == "."
            yield low.rstrip(".") if own else low, 0
            if own or (i + 1 < len(tokens) and tokens[i + 1] == "." and not spaces[i]):
                yield low.rstrip(".") if own else low, 1


def word_counts(docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(word, n, n_stop) over all documents: how often a word occurs, and how often with a stop right after it."""
    tool = tokenizer or Tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: Counter = Counter()

        def rows() -> pa.RecordBatch:
            counts: dict[str, list[int]] = {}
            for run, times in runs.items():
                tokens, _, spaces = tool(run)
                for word, k in words_and_stops(tokens, spaces):
                    counts.setdefault(word, [0, 0])[k] += times
            runs.clear()
            words = sorted(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([counts[w][k] for w in words], pa.int64()) for k in (0, 1))], ["word", "n", "n_stop"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                runs.update((text or "").split())  # a stop after a word stands in the same run, so equal runs are cut once
                if len(runs) > COUNTED:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "word string, n bigint, n_stop bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_stop").alias("n_stop"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(word, n, n_stop, score) of the abbreviations among counted words.

    The score is the ratio of the chance that nearly every occurrence (0.99) has a stop to the chance that stops come as
    often as anywhere, times e to the minus the word's length, its inner stops and one, and the length to the minus the
    occurrences without a stop.
    """
    words, stops = (float(x or 0) for x in counts.agg(F.sum("n"), F.sum("n_stop")).first())
    n, k, p = F.col("n").cast("double"), F.col("n_stop").cast("double"), F.lit(stops / words if words else 0.0)
    chance = lambda q: k * F.log(q) + (n - k) * F.log(1 - q)
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    length = (F.length("word") - inner).cast("double")
    score = 2 * (chance(F.lit(0.99)) - chance(p)) * F.exp(-length) * (inner + 1) * F.pow(length, -(n - k))
    return counts.where("n_stop > 0").where(F.lit(stops < words)).withColumn("score", score).where(F.col("score") >= ABBREVIATION).select("word", "n", "n_stop", "score")


def starters(counts: DataFrame) -> DataFrame:
    """(word, n, n_first, score) of words that begin sentences, after sure borders, far more often than others do.

    counts: (word, n, n_first). The score is the log-likelihood ratio of two binomials.
    """
    words, firsts = (float(x or 0) for x in counts.agg(F.sum("n"), F.sum("n_first")).first())
    n, k, m, b = F.col("n").cast("double"), F.col("n_first").cast("double"), F.lit(words), F.lit(firsts)
    part = lambda x, q: F.when(x > 0, x * F.log(q)).otherwise(0.0)
    both = lambda x, y, q: part(x, q) + part(y - x, 1 - q)
    p, p1, p2 = n / m, k / b, (n - k) / (m - b)
    score = 2 * (both(k, b, p1) + both(n - k, m - b, p2) - both(k, b, p) - both(n - k, m - b, p))
    return counts.where("n_first > 0").where(F.lit(firsts < words)).where(p1 > p).withColumn("score", score).where(F.col("score") >= STARTER).select("word", "n", "n_first", "score")


def _held(words: DataFrame, what: str) -> frozenset[str]:
    rows = words.select("word").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} {what}: learn from texts of fewer languages at a time")
    return frozenset(r[0] for r in rows)


def learn_borders(docs: DataFrame, tokenizer: Tokenizer | None = None, lines: bool = True) -> Borders:
    """A model of sentence borders from the texts of ``docs`` (text; null and empty ones say nothing).

    Only abbreviations and starters reach the driver; more than MOST_WORDS of them raise an error.
    """
    tool, stash = tokenizer or Tokenizer(), Stash(docs.sparkSession)
    first = Borders(_held(abbreviations(stash(word_counts(docs, tool))), "abbreviations"), lines=lines)
    counts = stash(first_word_counts(docs, first, tool))
    return Borders(first.abbreviations, _held(starters(counts), "sentence starters"), lines)


def first_word_counts(docs: DataFrame, borders: Borders, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(word, n, n_first): a word's occurrences, and those after a border that a sure mark makes."""

    def count(tokens: list[str], spaces: list[bool]) -> Iterator[tuple[str, int]]:
        marks = [(t, s) for t, s in zip(tokens, borders.numbers(tokens, spaces), strict=True) if not t.isspace()]
        last, before = 0, ""
        for t, s in marks:
            if _WORD.search(t):
                yield t.lower(), 0
                if s != last and before in ENDS:
                    yield t.lower(), 1
                last = s
            before = t

    return _counted(docs, tokenizer or Tokenizer(), count, "n n_first")
