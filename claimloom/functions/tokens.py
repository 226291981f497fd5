"""Tokens without loss: a text is its tokens, each followed by one blank if its flag says so.

A run without white space is cut from both ends: prefixes (opening marks, currency signs), suffixes (closing marks, units
after digits, contractions), then infixes in what is left. Exceptions, found in a trie from any left end, stay whole or
are cut as they say. White space that isn't a single blank after a token is a token of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

OPENING = "([{<\"'“”‘’«»„‚`´¿¡"
CLOSING = ")]}>\"'“”‘’«»„`´,;:!?。，！？"
CURRENCY = "$£€¥₹¢"
UNITS = "km m cm mm kg g mg µg ml ms hz khz mhz ghz gb mb kb tb °c °f % ° am pm bn".split()
#: Kept whole wherever they stand between marks; what else ends in a stop loses it.
ABBREVIATIONS = "U.S. U.K. U.N. E.U. D.C. a.m. p.m. e.g. i.e. Ph.D. Mr. Mrs. Ms. Dr. Prof. St. Jr. Sr. vs. etc. Inc. Ltd. Co. Corp. Gov. Sen. Rep. Gen. Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec.".split()

_LETTER = r"[^\W\d_]"
_PREFIX = re.compile(rf"[{re.escape(OPENING + CURRENCY)}§#&=|~…–—]|\.\.+|--+|-(?={_LETTER})|[+*/](?=\D)")
_SUFFIX = re.compile(
    rf"(?:[{re.escape(CLOSING)}…–—~|*=&/]|\.\.+|-+|(?<=[0-9])(?:{'|'.join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))})"
    rf"|(?<={_LETTER})n['’]t|(?<={_LETTER})['’](?:s|re|ve|ll|d|m)|[{re.escape(CURRENCY)}]|(?<=[^.])\.)$",
    re.IGNORECASE,
)
_INFIX = re.compile(rf"\.\.+|…|(?<={_LETTER})(?:--+|[-–—~])(?={_LETTER})|(?<=[^\W\d_a-zßà-öø-ÿ])\.(?=[^\W\d_a-zßà-öø-ÿ][^\W\d_]{{2}})|(?<=[a-zßà-öø-ÿ])\.(?=[^\W\d_a-zßà-öø-ÿ])|(?<={_LETTER})[,;!?](?={_LETTER})|(?<=\w)[:<>=/()\[\]{{}}\"“”«»](?=\w)|[—]")
#: Initials and letters with stops stay whole, as do addresses.
_WHOLE = re.compile(rf"(?:{_LETTER}\.)+|(?:https?://|www\.)\S*[\w/]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.IGNORECASE)
#: A run with the blank after it, or further white space: tokens and blanks of a unit don't depend on what is around it.
_UNITS = re.compile(r"\S+ ?|\s+")


class Trie:
    """The longest exception at a place, if no letter or digit follows it."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for w in words:
            at = self.root
            for c in w:
                at = at.setdefault(c, {})
            at[""] = w

    def longest(self, s: str, lo: int, hi: int) -> int:
        """Its length; 0 for none."""
        at, best = self.root, 0
        for i in range(lo, hi):
            at = at.get(s[i])
            if at is None:
                break
            if "" in at and (i + 1 == hi or not s[i + 1].isalnum()):
                best = i + 1 - lo
        return best


#: Tokens, their widths with the blank after them, and whether it is there.
Unit = tuple[tuple[str, ...], tuple[int, ...], tuple[bool, ...]]


class Known(dict[str, Unit]):
    """Units that were cut before; others are cut as they are asked for."""

    def __init__(self, cut: Callable[[str], Unit]):
        super().__init__()
        self.cut = cut

    def __missing__(self, unit: str) -> Unit:
        self[unit] = out = self.cut(unit)
        return out


class Tokenizer:
    """Cuts texts. exceptions: words that stay whole, or word to the lengths of its pieces."""

    def __init__(self, exceptions: Iterable[str] | dict[str, list[int]] = ABBREVIATIONS, known: int = 200_000):
        self.exceptions = dict(exceptions) if isinstance(exceptions, dict) else {w: [len(w)] for w in exceptions}
        for w, cuts in self.exceptions.items():
            if sum(cuts) != len(w) or min(cuts) < 1:
                raise ValueError(f"{w}: its pieces don't make it up")
        self.most, self.trie = known, Trie(self.exceptions)
        self.pieces = Known(self.unit)

    def __getstate__(self) -> dict:
        return {"exceptions": self.exceptions, "most": self.most}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["exceptions"], state["most"])

    def cut(self, s: str) -> tuple[str, ...]:
        """Pieces of a run without white space."""
        head, mark = s[:-1], s[-1]
        if s not in self.exceptions:  # most runs: letters, with one mark or none after them
            if s.isalpha():
                return (s,)
            if mark in ".,;:!?" and head.isalpha() and head not in self.exceptions and (mark != "." or len(head) > 1):
                return head, mark
        front: list[str] = []
        back: list[str] = []
        lo, hi = 0, len(s)
        while lo < hi:
            n = self.trie.longest(s, lo, hi)
            if n:
                for k in self.exceptions[s[lo : lo + n]]:
                    front.append(s[lo : lo + k])
                    lo += k
            elif _WHOLE.fullmatch(s, lo, hi):
                break
            elif (m := _PREFIX.match(s, lo, hi)) is not None:
                front.append(m[0])
                lo = m.end()
            else:
                break
        while lo < hi and not self.trie.longest(s, lo, hi) == hi - lo and not _WHOLE.fullmatch(s, lo, hi):
            m = _SUFFIX.search(s, lo, hi)
            if m is None or not m[0]:
                break
            back.append(m[0])
            hi = m.start()
        if lo < hi:
            if s[lo:hi] in self.exceptions:
                for k in self.exceptions[s[lo:hi]]:
                    front.append(s[lo : lo + k])
                    lo += k
            elif _WHOLE.fullmatch(s, lo, hi):
                front.append(s[lo:hi])
            else:
                for m in _INFIX.finditer(s, lo, hi):
                    front += [x for x in (s[lo : m.start()], m[0]) if x]
                    lo = m.end()
                front += [s[lo:hi]] if lo < hi else []
        return (*front, *back[::-1])

    def unit(self, unit: str) -> Unit:
        space = unit[-1] == " "
        run = unit[:-1] if space else unit
        if not run or run[0].isspace():
            return (unit,), (len(unit),), (False,)
        tokens = self.cut(run)
        if len(tokens) == 1:
            return tokens, (len(unit),), (space,)
        widths = list(map(len, tokens))
        widths[-1] += space
        return tokens, tuple(widths), (*[False] * (len(tokens) - 1), space)

    def __call__(self, text: str) -> tuple[list[str], list[int], list[bool]]:
        """Tokens, where each begins, and whether a blank follows it."""
        if len(self.pieces) > self.most:
            self.pieces.clear()
        units = list(map(self.pieces.__getitem__, _UNITS.findall(text)))
        if not units:
            return [], [], []
        tokens, widths, spaces = (list(chain.from_iterable(x)) for x in zip(*units, strict=True))
        return tokens, list(accumulate(widths[:-1], initial=0)), spaces


#: Letters for which Arrow's and Python's rules are surely the same, and what of them needs no further look: with one mark or none.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
_EASY = f"^([{LETTERS}]+[,;:!?]?|[{LETTERS}]{{2,}}[.])$"


@dataclass
class Numbered:
    """Tokens of many texts as numbers of different ``words``: ``numbers``, whether a blank follows each, how many each text has.

    names: the words as strings; odd: those of them that aren't of ``LETTERS`` alone; blank: whether a word is white space.
    """

    words: pa.Array
    names: list[str]
    odd: np.ndarray
    blank: np.ndarray
    numbers: np.ndarray
    spaces: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(texts: pa.Array, tool: Tokenizer) -> Numbered:
        """As by the tokenizer, but what stands between blanks is cut once for all texts, and words with a mark at once."""
        if not len(texts):
            none = np.empty(0, np.int64)
            return Numbered(pa.array([], pa.string()), [], none, none.astype(bool), none, none.astype(bool), none)
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        row, pieces, last = np.asarray(coded.indices).astype(np.int64), coded.dictionary, np.cumsum(n) - 1
        stems, kept = pc.utf8_rtrim(pieces, characters=MARKS), pa.array(sorted(tool.exceptions), pa.string())
        easy = np.asarray(pc.match_substring_regex(pieces, _EASY)) & ~np.asarray(pc.is_in(pieces, value_set=kept)) & ~np.asarray(pc.is_in(stems, value_set=kept))
        marked = easy & np.asarray(pc.not_equal(pc.binary_length(pieces), pc.binary_length(stems)))
        hard, final = np.flatnonzero(~easy), last[~easy[row[last]]]  # no blank follows a text's last piece
        runs = [*[f"{p} " for p in pieces.take(pa.array(hard)).to_pylist()], *pieces.take(pa.array(row[final])).to_pylist()]
        if len(tool.pieces) > tool.most:
            tool.pieces.clear()
        units = [[tool.pieces[u] for u in _UNITS.findall(r)] for r in runs]
        tokens, flags = [t for us in units for u in us for t in u[0]], [s for us in units for u in us for s in u[2]]
        # rows: the pieces, and those at the end of a text that aren't easy; each has the tokens from first[row] on
        many = np.r_[np.where(easy, 1 + marked, 0), np.zeros(len(final), np.int64)]
        rows = np.r_[hard, len(pieces) + np.arange(len(final))]
        many[rows] = [sum(len(u[0]) for u in us) for us in units]
        first = np.cumsum(many) - many
        some, marks = np.flatnonzero(easy), pa.array(list(MARKS), pa.string())
        cut, space = np.empty(many.sum(), np.int64), np.zeros(many.sum(), bool)
        cut[first[some]] = np.arange(len(some))
        with_mark = np.flatnonzero(marked)
        cut[first[with_mark] + 1] = len(some) + np.asarray(pc.index_in(pc.utf8_slice_codeunits(pieces.take(pa.array(with_mark)), -1), value_set=marks)).astype(np.int64)
        space[(first + many - 1)[some]] = True
        at = _ranges(first[rows], many[rows])
        cut[at], space[at] = len(some) + len(MARKS) + np.arange(len(tokens)), np.array(flags, bool)
        coded = pc.dictionary_encode(pa.concat_arrays([stems.take(pa.array(some)), marks, pa.array(tokens, pa.string())]))
        number, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        cut, odd = number[cut], np.unique(number[len(some) :])
        row[final] = len(pieces) + np.arange(len(final))
        each = many[row]
        at = _ranges(first[row], each)
        numbers, spaces = cut[at], space[at]
        spaces[(np.cumsum(each) - 1)[last[row[last] < len(pieces)]]] = False
        names, blank = words.to_pylist(), np.zeros(len(words), bool)
        blank[odd] = [names[k].isspace() for k in odd.tolist()]
        return Numbered(words, names, odd, blank, numbers, spaces, np.add.reduceat(each, last + 1 - n))._joined()

    def _joined(self) -> Numbered:
        """White space that was parted at a blank is one token."""
        text, blank = np.repeat(np.arange(len(self.n)), self.n), self.blank[self.numbers]
        more = np.flatnonzero(blank[1:] & blank[:-1] & (text[1:] == text[:-1])) + 1
        if not len(more):
            return self
        new, numbers, names = np.diff(more) > 1, self.numbers.copy(), list(self.names)
        for a, b in zip((more[np.r_[True, new]] - 1).tolist(), (more[np.r_[new, True]] + 1).tolist(), strict=True):
            numbers[a] = len(names)
            names.append("".join([self.names[k] for k in self.numbers[a:b].tolist()]))
        added, kept = len(names) - len(self.names), np.ones(len(numbers), bool)
        kept[more] = False
        words = pa.concat_arrays([self.words, pa.array(names[len(self.names) :], pa.string())])
        odd, blank = np.r_[self.odd, len(self.names) + np.arange(added)], np.r_[self.blank, np.ones(added, bool)]
        return Numbered(words, names, odd, blank, numbers[kept], self.spaces[kept], np.bincount(text[kept], minlength=len(self.n)))


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, as many as are said, one range after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def rebuilt(tokens: Iterable[str], spaces: Iterable[bool]) -> str:
    return "".join(t + " " if s else t for t, s in zip(tokens, spaces, strict=True))


#: Bytes of text that are made into tokens at once.
PART = 1 << 20
_FIELDS = [("text", pa.string(), StringType()), ("start", pa.int32(), IntegerType()), ("space", pa.bool_(), BooleanType()), ("sent", pa.int32(), IntegerType())]
TOKEN = StructType([StructField(n, kind) for n, _, kind in _FIELDS])


def tokenised_documents(docs: DataFrame, tokenizer: Tokenizer | None = None, borders=None) -> DataFrame:
    """``docs`` with ``tokens``, an array of (text, start, space, sent) for ``text``: whole documents, nothing dropped.

    start counts characters from 0, sent sentences; borders: operators.borders.Borders, by default without abbreviations of
    its own. A null text has null tokens, an empty one none. A column named tokens is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "tokens"]
    schema = StructType([*[docs.schema[c] for c in kept], StructField("tokens", ArrayType(TOKEN))])
    return docs.select([f"`{c}`" for c in kept]).mapInArrow(tokenising(kept, tokenizer, borders), schema)


def in_parts(batch: pa.RecordBatch, column: str, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have ``most`` bytes together, or that are one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part, first = np.cumsum(size) // most, 0
    for last in [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]:
        if first < last:
            yield batch.slice(first, last - first)
        first = last


def tokenising(kept: list[str], tokenizer: Tokenizer | None = None, borders=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a ``text`` to batches of ``kept`` and ``tokens``. Tokens take many times a text's memory, so a batch is cut."""
    from ..operators.borders import Borders

    tool, marks = tokenizer or Tokenizer(), borders or Borders()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole, "text")):
            ends, columns, null = [0], [[], [], [], []], []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    words, starts, spaces = tool(text)
                    for column, new in zip(columns, (words, starts, spaces, marks.numbers(words, spaces)), strict=True):
                        column += new
                null.append(text is None)
                ends.append(len(columns[0]))
            flat = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(columns, _FIELDS, strict=True)], names=[n for n, *_ in _FIELDS])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(null, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], [*kept, "tokens"])

    return run


def token_words(text: Column, tokenizer: Tokenizer | None = None) -> Column:
    """The text's tokens without white space, punctuation included; null for null."""
    tool = tokenizer or Tokenizer()

    @F.pandas_udf(ArrayType(StringType()))
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [w for w in tool(t)[0] if not w.isspace()] for t in texts], dtype=object)

    return words(text)
