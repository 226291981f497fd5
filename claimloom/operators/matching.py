"""Token-pattern matching: pattern sequences over token attributes, all followed in one pass (see ``automaton``).

All overlapping matches are returned, as a matcher without a greedy mode does. The tokens of a whole Arrow batch are classed
at once, column by column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from .automaton import Automaton, Pattern

#: What the placeholder in a TEXT list stands for (fixed values).
NAME_VARIATIONS = ["COVID-19", "Coronavirus", "SARS-CoV-2", "coronavirus", "corona virus", "covid-19", "covid 19"]
PLACEHOLDER = "CORONA_NAME_VARIATIONS"
ATTRIBUTES = {"TEXT": "text", "LOWER": "lower", "LEMMA": "lemma", "POS": "pos", "ENT_TYPE": "ent_type"}


def load_patterns(source: str, names: list[str] | None = None) -> list[Pattern]:
    """Patterns of a JSON text {template: [[{attribute: value or {"IN": [...]}, "OP": quantifier}, ...], ...]}."""
    names = NAME_VARIATIONS if names is None else names
    out = []
    for template, sequences in json.loads(source).items():
        for k, steps in enumerate(sequences):
            out.append(compile_pattern(template, k, steps, names))
    return out


def compile_pattern(template: str, pattern_id: int, steps: list[dict], names: list[str]) -> Pattern:
    wanted: list[list[tuple[str, tuple[str, ...]]]] = []
    for step in steps:
        one = []
        for name, value in step.items():
            if name == "OP":
                continue
            values = value["IN"] if isinstance(value, dict) else value
            values = names if values == PLACEHOLDER else [values] if isinstance(values, str) else list(values)
            one.append((ATTRIBUTES[name.upper()], tuple(values)))
        wanted.append(one)
    predicates = list(dict.fromkeys(p for one in wanted for p in one))
    ops = ["" if step.get("OP", "") == "1" else step.get("OP", "") for step in steps]
    if not set(ops) <= {"", "?", "*", "+"}:
        raise ValueError(f"{template}: a quantifier other than 1, ?, * and +")
    return Pattern(template, pattern_id, tuple(predicates), tuple((tuple(predicates.index(p) for p in one), op) for one, op in zip(wanted, ops, strict=True)))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Lexicon:
    """Tags by word: entries (lemma, pos) of words in lower case; other words are their own lemmas, with ``pos``."""

    entries: dict[str, tuple[str, str]]
    pos: str = ""
    #: part of speech of words without a letter or digit; by default that of other words
    mark: str | None = None

    def columns(self, words: pa.Array, wanted: Iterable[str]) -> dict[str, pa.Array]:
        """The wanted attributes; each different word is looked up once."""
        coded = pc.dictionary_encode(words)
        different = pc.utf8_lower(coded.dictionary).to_pylist()
        of = {"lemma": lambda w: self.entries[w][0] if w in self.entries else w, "pos": lambda w: self.entries[w][1] if w in self.entries else self.pos, "lower": lambda w: w, "ent_type": lambda w: ""}
        if self.mark is not None and "pos" in wanted:
            lettered = pc.match_substring_regex(coded.dictionary, r"[\p{L}\p{N}]").to_pylist()
            marks = {w for w, has in zip(different, lettered, strict=True) if has is False}
            of |= {"pos": lambda w: self.mark if w in marks else self.entries[w][1] if w in self.entries else self.pos}
        return {a: words if a == "text" else pa.array([of[a](w) for w in different], pa.string()).take(coded.indices) for a in wanted}


def matches(units: DataFrame, patterns: list[Pattern], tokens: str = "tokens", most_tokens: int | None = None, keep: list[str] | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """Units with template, pattern_id, first and last (token positions, last exclusive): a row for each match.

    tokens: an array of structs with text, lemma, pos and ent_type, or of words, which ``lexicon`` then tags. keep: columns of the units that the result has, by
    default all; fewer are cheaper. most_tokens bounds the length of matches of patterns with an open quantifier; without
    it, they may span the unit. Units without a match give no row; a null token has none of the attributes.
    """
    kept = units.columns if keep is None else keep
    automaton = Automaton(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(tokens)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat, total = lists.flatten(), int(n.sum())
            if pa.types.is_struct(flat.type):
                columns = {a: pc.utf8_lower(pc.struct_field(flat, "text")) if a == "lower" else pc.struct_field(flat, a) for a in automaton.values}
            else:
                columns = (lexicon or Lexicon({})).columns(flat, automaton.values)
            ends = np.cumsum(n)
            number, first, last = automaton.find(automaton.classes_of(columns, total), np.repeat(ends, n), most_tokens)
            unit = np.searchsorted(ends, first, side="right")
            at = (ends - n)[unit]
            taken = batch.select(kept).take(pa.array(unit))
            names = pa.array([p.template for p in patterns], pa.string()), pa.array([p.pattern_id for p in patterns], pa.int32())
            made = [*(x.take(pa.array(number)) for x in names), pa.array(first - at, pa.int32()), pa.array(last - at, pa.int32())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], [*kept, "template", "pattern_id", "first", "last"])

    fields = [f for f in (units.schema[c] for c in kept)]
    schema = StructType([*fields, StructField("template", StringType()), StructField("pattern_id", IntegerType()), StructField("first", IntegerType()), StructField("last", IntegerType())])
    return units.select(*dict.fromkeys([*kept, tokens])).mapInArrow(run, schema)


def tokenised(docs: DataFrame, tagger=None) -> DataFrame:
    """(doc_id, sent_id, sentence, tokens): words of each sentence with offsets, lemma, part of speech and entity type.

    Further columns of the documents stay. tagger: word column to (lemma, pos, ent_type) columns; by default the lower-cased word and nothing else.
    """
    tagger = tagger or (lambda w: (F.lower(w), F.lit(""), F.lit("")))

    def token(w: Column, i: Column) -> Column:
        lemma, pos, ent = tagger(w)
        return F.struct(i.alias("i"), w.alias("text"), lemma.alias("lemma"), pos.alias("pos"), ent.alias("ent_type"))

    return worded(docs).withColumn("tokens", F.transform("tokens", token))


def worded(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_id, sentence, tokens): the words of each sentence that has one. Further columns of the documents stay."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    s = docs.where("text IS NOT NULL").select("doc_id", *more, F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "sentence"))
    # a test of the sentence rather than of its tokens, which would be made twice
    return s.where(F.col("sentence").rlike(T.WORD)).withColumn("tokens", T.words(F.col("sentence")))


def sentence_starts(text: Column) -> Column:
    """Where each of the text's sentences (functions.text.sentences) begins, in characters."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def starts(texts: pd.Series) -> pd.Series:
        of = lambda t: None if t is None else [m.start() + len(m[0]) - len(m[0].lstrip(" ")) for m in re.finditer(r"[^.!?\n]+", t) if m[0].strip(" ")]
        return pd.Series([of(t) for t in texts], dtype=object)

    return starts(text)


def running_offsets(tokens: DataFrame) -> DataFrame:
    """Tokens (unit keys, ``tok_id``, ``token``, ``space``) with ``start`` and inclusive ``stop``: lengths before it are summed."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("token") + F.col("space").cast("int")).over(w), F.lit(0)).cast("int")
    return tokens.withColumn("start", start).withColumn("stop", F.col("start") + F.char_length("token") - 1)


def search_offsets(text: Column, tokens: Column) -> Column:
    """(token, start, stop inclusive) of each token, each searched for past the summed lengths of those before it.

    A token that isn't found there gets -1 and a stop before 0. A null text or list gives null.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def of(t, words):
            if t is None or words is None:
                return None
            low, out = 0, []
            for w in words:
                out.append(t.find(w, low))
                low += len(w)
            return out

        return pd.Series([of(t, words) for t, words in zip(texts, lists, strict=True)], dtype=object)

    return F.zip_with(tokens, places(text, tokens), lambda t, at: F.struct(t.alias("token"), at.alias("start"), (at + F.char_length(t) - 1).alias("stop")))


def span_of_text(firsts: Column, lasts: Column) -> Column:
    """(start, stop) of a text from the offsets of its first and last token: the latest start that some end follows, and
    the earliest end after it; null if there is none. firsts and lasts: arrays of start and of inclusive stop.
    """
    start = _let(F.array_max(lasts), lambda last: F.array_max(F.filter(firsts, lambda f: f < last)))
    return _let(start, lambda s: F.when(s.isNotNull(), F.struct(s.alias("start"), F.array_min(F.filter(lasts, lambda e: e > s)).alias("stop"))))
