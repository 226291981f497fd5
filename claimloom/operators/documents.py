"""Documents as lists of tokens: their table form, tags, and claims found by patterns over whole documents.

A document has ``tokens``, an array of (text, start, space, sent, lemma, pos, ent_type). As a table a token is a row, with
its place ``i``; tags of a tagger are brought in that form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.tokens import Tokenizer, tokenising
from .automaton import Automaton, Pattern
from .matching import Lexicon

#: What a token says of itself beside its text and place.
TAGS = ["lemma", "pos", "ent_type"]
FIELDS = ["text", "start", "space", "sent", *TAGS]


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, i, and what the tokens have): a row for each token; documents without tokens have no row."""
    return docs.select("doc_id", F.posexplode("tokens").alias("i", "t")).select("doc_id", "i", "t.*")


def documents_of(table: DataFrame) -> DataFrame:
    """Documents (doc_id, tokens) of a token table (doc_id, i, text, ...), tokens in the order of i.

    Where columns are missing: start is counted from the texts and blanks, space is true, sent 0, and tags are null.
    """
    there = [c for c in FIELDS if c in table.columns]
    docs = table.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", *there))).alias("tokens"))
    has = lambda t, c, other: t[c] if c in there else other
    if "start" not in there:
        # (start, the next one's start) of each token, one after the other
        length = lambda t: F.char_length(t["text"]) + F.coalesce(has(t, "space", F.lit(True)), F.lit(False)).cast("int")
        starts = F.aggregate("tokens", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + length(t))))
        docs = docs.withColumn("tokens", F.transform(F.arrays_zip("tokens", F.slice(starts, 1, F.size("tokens")).alias("s")), lambda x: x["tokens"].withField("start", x["s"])))
        there = [*there, "start"]
    full = lambda t: F.struct(*[has(t, c, F.lit({"space": True, "sent": 0}.get(c)).cast({"space": "boolean", "sent": "int", "start": "int"}.get(c, "string"))).alias(c) for c in FIELDS])
    return docs.select("doc_id", F.transform("tokens", full).alias("tokens"))


def tagged(docs: DataFrame, tagger=None) -> DataFrame:
    """Documents whose tokens have lemma, pos and ent_type by ``tagger``, a function of a word column to three columns.

    By default the lemma is the word in lower case, and the others are empty.
    """
    tagger = tagger or (lambda w: (F.lower(w), F.lit(""), F.lit("")))

    def with_tags(t: Column) -> Column:
        return F.struct(*[t[c].alias(c) for c in FIELDS[:4]], *[v.alias(c) for c, v in zip(TAGS, tagger(t["text"]), strict=True)])

    return docs.withColumn("tokens", F.transform("tokens", with_tags))


def text_of(tokens: Column) -> Column:
    """The text that the tokens make up, blanks included."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], F.when(t["space"], " ").otherwise(""))), "")


CLAIM = [("template", pa.string(), StringType()), ("pattern_id", pa.int32(), IntegerType()), ("first", pa.int32(), IntegerType()), ("last", pa.int32(), IntegerType()), ("claim_text", pa.string(), StringType()), ("span_start", pa.int32(), IntegerType()), ("span_stop", pa.int32(), IntegerType()), ("sent_id", pa.int32(), IntegerType()), ("claim_sentence", pa.string(), StringType()), ("sent_start", pa.int32(), IntegerType())]


def document_matches(docs: DataFrame, patterns: list[Pattern], most_tokens: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """A row for each match of a pattern in a document's tokens, over sentence borders too.

    template, pattern_id, first and last (exclusive) token, claim_text with its place in the document's characters
    (span_stop exclusive), and the sentence that it begins in, whole, with its number and start. keep: further columns, by
    default all but the tokens. All overlapping matches are given. A document without tokens gives none.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "tokens"]
    schema = StructType([*[docs.schema[c] for c in kept], *[StructField(c, kind) for c, _, kind in CLAIM]])
    return docs.select(*kept, "tokens").mapInArrow(_matching(patterns, kept, most_tokens), schema)


def text_matches(docs: DataFrame, patterns: list[Pattern], lexicon: Lexicon, columns: list[str], tokenizer: Tokenizer | None = None, keep: list[str] | None = None, borders=None, most_tokens: int | None = None) -> DataFrame:
    """``document_matches`` of documents by their ``text``, in one pass: their tokens are tagged by a lexicon and don't leave the task.

    columns: those of the result that are made, beside ``keep``, by default all columns but the text.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "text"]
    cut, find = tokenising(kept, tokenizer, borders), _matching(patterns, kept, most_tokens, lexicon, columns)
    schema = StructType([*[docs.schema[c] for c in kept], *[StructField(c, kind) for c, _, kind in CLAIM if c in columns]])
    return docs.select(*kept, "text").mapInArrow(lambda batches: find(cut(batches)), schema)


def _matching(patterns: list[Pattern], kept: list[str], most_tokens: int | None = None, lexicon: Lexicon | None = None, wanted: list[str] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with tokens to batches of ``kept`` and of what is wanted of CLAIM; lexicon: gives tags to tokens without them."""
    automaton = Automaton(patterns)
    claim = [(c, kind) for c, kind, _ in CLAIM if wanted is None or c in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            flat, ends = lists.flatten(), np.cumsum(n)
            if lexicon:
                columns = lexicon.columns(pc.struct_field(flat, "text"), automaton.values)
            else:
                columns = {a: pc.utf8_lower(pc.struct_field(flat, "text")) if a == "lower" else pc.struct_field(flat, a) for a in automaton.values}
            number, first, last = automaton.find(automaton.classes_of(columns, len(flat)), np.repeat(ends, n), most_tokens)
            unit = np.searchsorted(ends, first, side="right")
            sent = np.asarray(pc.fill_null(pc.struct_field(flat, "sent"), 0))
            start = np.asarray(pc.fill_null(pc.struct_field(flat, "start"), 0))
            begins, stops = _sentences(sent, ends - n, n)
            words, space = pc.fill_null(pc.struct_field(flat, "text"), ""), np.asarray(pc.fill_null(pc.struct_field(flat, "space"), False))
            told: dict[tuple[int, int], str] = {}

            def text(a: int, b: int, words=words, space=space, told=told) -> str:
                if (a, b) not in told:
                    some = words.slice(a, b - a).to_pylist()
                    told[a, b] = "".join(w + " " if s else w for w, s in zip(some, space[a:b].tolist(), strict=True)).strip()
                return told[a, b]

            def texts(a: np.ndarray, b: np.ndarray, text=text) -> list[str]:
                return [text(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]

            at = (ends - n)[unit]
            made = {
                "template": lambda: pa.array([p.template for p in patterns], pa.string()).take(pa.array(number)), "pattern_id": lambda: pa.array([p.pattern_id for p in patterns], pa.int32()).take(pa.array(number)),
                "first": lambda: first - at, "last": lambda: last - at, "claim_text": lambda: texts(first, last), "span_start": lambda: start[first],
                "span_stop": lambda: start[last - 1] + np.asarray(pc.utf8_length(words.take(pa.array(last - 1)))), "sent_id": lambda: sent[first],
                "claim_sentence": lambda: texts(begins[first], stops[first]), "sent_start": lambda: start[begins[first]],
            }
            taken = batch.select(kept).take(pa.array(unit))
            got = [(made[c](), kind) for c, kind in claim]
            yield pa.RecordBatch.from_arrays([*taken.columns, *[x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in got]], [*kept, *[c for c, _ in claim]])

    return run


def _sentences(sent: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the first token of its sentence and the one after its last."""
    total = len(sent)
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.r_[True, sent[1:] != sent[:-1]]
    new[starts[n > 0]] = True
    at = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return at[which], np.r_[at[1:], total][which]
