"""Parts of speech (or other tags of tokens) by a second-order sequence model that is learned from a table of tagged tokens.

A tag is scored by features of the word and its neighbours and by the two tags before it; the best sequence of a sentence is
found by Viterbi's recursion over pairs of tags. Weights are learned by the averaged perceptron, in shards: each shard of
the sentences goes through an epoch from the weights that all shards begin with, and their means begin the next one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.tokens import LETTERS, Numbered, Tokenizer, in_parts, tokenised_documents
from ..session import Stash
from .borders import Borders, later_sentences
from .documents import token_table

#: Sentences that a model is fitted on at most, by a hash; shards that learn at once; passes.
FIT_SENTENCES, SHARDS, EPOCHS = 40_000, 8, 4
#: Weights that a model may have: it goes to every task.
MOST_WEIGHTS = 5_000_000
SPACE = "SPACE"
#: Paths that are followed at once, over all sentences.
PATHS = 1 << 20
#: Feature names of tag pairs and triples begin with it; no feature of a word does.
CHAIN = "\x1f"


class _Shapes(dict[int, str]):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c
        return out


_SHAPES = _Shapes()
_AGAIN = re.compile(r"(.)\1+", re.DOTALL)


def word_features(word: str) -> tuple[str, ...]:
    """What a word says by itself: its form, endings, beginning and shape."""
    low = word.lower()
    short = _AGAIN.sub(r"\1", word[:12].translate(_SHAPES))
    return (f"w={low}", *(f"s={low[-k:]}" for k in (1, 2, 3) if len(low) > k), f"p={low[:1]}", f"h={short}")


class SequenceTagger:
    """tags; weights: feature to an array of a weight for each tag; chain[a, b, c]: of tag c after a and b (the last index: none)."""

    def __init__(self, tags: list[str], weights: dict[str, np.ndarray] | None = None, chain: np.ndarray | None = None):
        self.tags, self.weights = list(tags), weights if weights is not None else {}
        n = len(self.tags)
        self.chain = chain if chain is not None else np.zeros((n + 1, n + 1, n))
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> tuple:
        return self.tags, self.weights, self.chain

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def features(self, words: list[str]) -> list[tuple[str, ...]]:
        own = []
        for w in words:
            if w not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[w] = word_features(w)
            own.append(self.known[w])
        low = ["", *[w.lower() for w in words], ""]
        return [(*f, f"-={low[i]}", f"+={low[i + 2]}") for i, f in enumerate(own)]

    def scores(self, features: list[tuple[str, ...]]) -> np.ndarray:
        out, get = np.zeros((len(features), len(self.tags))), self.weights.get
        for row, some in zip(out, features, strict=True):
            for f in some:
                w = get(f)
                if w is not None:
                    row += w
        return out

    def decode(self, scores: np.ndarray) -> list[int]:
        """The sequence of the highest score; of equal ones that with the first tags, from the end."""
        n, k = scores.shape
        if not n or not k:
            return []
        best = np.full((k + 1, k + 1), -np.inf)  # by the last two tags
        best[k, k] = 0
        back = np.empty((n, k + 1, k), np.int32)
        for i in range(n):
            paths = best[:, :, None] + self.chain
            back[i] = paths.argmax(0)
            best = np.full((k + 1, k + 1), -np.inf)
            best[:, :k] = np.take_along_axis(paths, back[i][None], 0)[0] + scores[i]
        b, c = np.unravel_index(best.argmax(), best.shape)
        out = []
        for i in range(n - 1, -1, -1):
            out.append(int(c))
            b, c = back[i, b, c], b
        return out[::-1]

    def __call__(self, words: list[str]) -> list[str]:
        return [self.tags[k] for k in self.decode(self.scores(self.features(words)))]

    def tags_of(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """The number of each word's tag, for sentences of these sizes one after the other: as by ``decode``, many at once."""
        coded, decoder = pc.dictionary_encode(words), Decoder(self)
        own, before, after = decoder.scores(pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary]))
        return decoder.tags(np.asarray(coded.indices).astype(np.int64) + 1, sizes, own, before, after)

    def learn(self, sentences: Iterator[tuple[list[str], list[str]]]) -> tuple[SequenceTagger, int]:
        """Goes through tagged sentences, changing itself where it errs. Returns the mean of what it was, and how many came."""
        number, n, time = {t: i for i, t in enumerate(self.tags)}, len(self.tags), 0
        late = SequenceTagger(self.tags)  # changes times the sentences before them

        def change(features: list[tuple[str, ...]], tags: list[int], by: float) -> None:
            a = b = n
            for some, c in zip(features, tags, strict=True):
                for model, step in ((self, by), (late, by * time)):
                    for f in some:
                        if f not in model.weights:
                            model.weights[f] = np.zeros(n)
                        model.weights[f][c] += step
                    model.chain[a, b, c] += step
                a, b = b, c

        for words, tags in sentences:
            features, gold = self.features(words), [number[t] for t in tags]
            found = self.decode(self.scores(features))
            if found != gold:
                change(features, gold, 1.0)
                change(features, found, -1.0)
            time += 1
        if not time:
            return self, 0
        none = np.zeros(n)
        mean = {f: w - late.weights.get(f, none) / time for f, w in self.weights.items()}
        return SequenceTagger(self.tags, mean, self.chain - late.chain / time), time

    def rows(self) -> Iterator[tuple[str, str, float]]:
        """(feature, tag, weight) of all weights that aren't 0."""
        name = [*self.tags, ""]
        for f, w in self.weights.items():
            for k in np.flatnonzero(w):
                yield f, self.tags[k], float(w[k])
        for a, b, c in zip(*np.nonzero(self.chain), strict=True):
            yield f"{CHAIN}{name[a]}{CHAIN}{name[b]}", self.tags[c], float(self.chain[a, b, c])

    @staticmethod
    def of(tags: list[str], features: list[str], own: list[str], weights: list[float]) -> SequenceTagger:
        out = SequenceTagger(tags)
        number = {t: i for i, t in enumerate(tags)} | {"": len(tags)}
        for f, t, w in zip(features, own, weights, strict=True):
            if f.startswith(CHAIN):
                a, b = f[1:].split(CHAIN)
                out.chain[number[a], number[b], number[t]] = w
            else:
                if f not in out.weights:
                    out.weights[f] = np.zeros(len(tags))
                out.weights[f][number[t]] = w
        return out


class Decoder:
    """Decodes many sentences at once, by a model that doesn't change any more."""

    def __init__(self, model: SequenceTagger):
        self.k, self.chain = len(model.tags), model.chain
        self.row = {f: i for i, f in enumerate(model.weights)}
        self.weights = np.array([*model.weights.values(), np.zeros(self.k)])  # the last row: of no feature
        self.kind = np.int8 if self.k < 128 else np.int16
        #: by what features begin with: how they go on, and their rows
        self.parts = {p: (pa.array([f[2:] for f in self.row if f[:2] == p], pa.string()), np.array([*[i for f, i in self.row.items() if f[:2] == p], len(self.row)])) for p in ("w=", "s=", "p=", "h=", "-=", "+=")}

    def scores(self, words: pa.Array) -> np.ndarray:
        """By tag, for each word: its own, what it says of the word after it, what of the word before it. "": a sentence's end."""
        get, none = self.row.get, len(self.row)
        plain = np.asarray(pc.match_substring_regex(words, f"^[{LETTERS}]+$"))
        rows = np.full((8, len(words)), none)
        rows[:, plain] = self._plain(words.filter(pa.array(plain)))
        others = np.flatnonzero(~plain)
        for i, w in zip(others.tolist(), words.take(pa.array(others)).to_pylist(), strict=True):
            for j, f in enumerate(word_features(w)):
                rows[j, i] = get(f, none)
            low = w.lower()
            rows[6, i], rows[7, i] = get(f"-={low}", none), get(f"+={low}", none)
        own = np.zeros((len(words), self.k))
        for some in rows[:6]:  # in the order of the features
            own += self.weights[some]
        return np.stack([own, self.weights[rows[6]], self.weights[rows[7]]])

    def _plain(self, words: pa.Array) -> list[np.ndarray]:
        """Rows of ``word_features`` and of the neighbours' ones, for words of LETTERS."""
        low, size = pc.utf8_lower(words), np.asarray(pc.utf8_length(words))
        shape = pc.utf8_slice_codeunits(words, 0, 12)
        for letters, sign in (("A-ZÀ-ÖØ-Þ", "X"), ("a-zß-öø-ÿ", "x")):
            shape = pc.replace_substring_regex(shape, f"[{letters}]+", sign)

        def rows(part: str, rest: pa.Array) -> np.ndarray:
            known, at = self.parts[part]
            return at[np.asarray(pc.fill_null(pc.index_in(rest, value_set=known), len(known))).astype(np.int64)]

        ends = [np.where(size > k, rows("s=", pc.utf8_slice_codeunits(low, -k)), len(self.row)) for k in (1, 2, 3)]
        return [rows("w=", low), *ends, rows("p=", pc.utf8_slice_codeunits(low, 0, 1)), rows("h=", shape), rows("-=", low), rows("+=", low)]

    def tags(self, at: np.ndarray, sizes: np.ndarray, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The number of each word's tag; at: the word's place in the scores, whose first row is of sentences' ends."""
        out, sizes = np.empty(len(at), np.int64), sizes[sizes > 0]
        ends = np.cumsum(sizes)
        left, right = np.r_[0, at[:-1]][: len(at)], np.r_[at[1:], 0][: len(at)]
        left[ends - sizes] = 0
        right[ends - 1] = 0
        scores = np.ascontiguousarray((own[at] + before[left] + after[right]).T)
        order = np.argsort(-sizes, kind="stable")
        most = max(1, PATHS // self.chain.size)
        for k in range(0, len(order), most):
            some = order[k : k + most]
            self._decode(scores, (ends - sizes)[some], sizes[some], out)
        return out

    def _decode(self, scores: np.ndarray, first: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """Sentences at ``first``, of falling sizes: in each step one more word of all that are so long, a sentence a column."""
        k, longest = self.k, int(sizes[0])
        lives = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()  # how many have a word at each place
        b, c = np.full(len(first), k), np.zeros(len(first), np.int64)
        best, back = np.zeros((k, len(first))), []
        for i, n in enumerate(lives):
            own = scores[:, first[:n] + i]
            if i == 0:
                best = self.chain[k, k][:, None] + own
            elif i == 1:
                best = best[:, None, :n] + self.chain[k, :k, :, None] + own
            else:
                paths, from_ = best[0, :, None, :n] + self.chain[0, :k, :, None], np.zeros((k, k, n), self.kind)
                for a in range(1, k):
                    other = best[a, :, None, :n] + self.chain[a, :k, :, None]
                    # of equal ones the first; a number is larger than those before it
                    np.maximum(from_, (other > paths).view(np.int8) * self.kind(a), out=from_)
                    np.maximum(paths, other, out=paths)
                best = paths
                best += own
                back.append(from_)
            over = lives[i + 1] if i + 1 < longest else 0  # those after it end here
            if over < n:
                last = best[..., over:].reshape(-1, n - over).argmax(0)
                if i:
                    b[over:n], c[over:n] = np.divmod(last, k)
                else:
                    c[over:n] = last
        for i in range(longest - 1, -1, -1):
            n = lives[i]
            out[first[:n] + i] = c[:n]
            if i:
                b[:n], c[:n] = back[i - 2][b[:n], c[:n], np.arange(n)] if i > 1 else k, b[:n].copy()


MODEL = "feature string, tag string, weight double"


def sentences_of(tokens: DataFrame, column: str = "pos") -> DataFrame:
    """(key, words, tags) of each sentence of a token table (doc_id, sent, i, text and the tags); white space is left out.

    A sentence with a token that has no tag is left out.
    """
    t = tokens.where("text rlike '[^\\\\s]'").groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("i", "text", F.col(column).alias("tag")))).alias("t"))
    part = lambda c: F.transform("t", lambda x: x[c])
    return t.where(~F.exists("t", lambda x: x["tag"].isNull())).select(F.xxhash64("doc_id", "sent").alias("key"), part("text").alias("words"), part("tag").alias("tags"))


def _shard(model, tags: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = SequenceTagger(tags, {f: w.copy() for f, w in model.value.weights.items()}, model.value.chain.copy())
        mean, n = own.learn((list(w), list(t)) for df in batches for w, t in zip(df["words"], df["tags"], strict=True))
        if n:
            # "": how many shards have learned
            rows = [(f, t, w, 0.0) for f, t, w in own.rows()] + [(f, t, 0.0, w) for f, t, w in mean.rows()] + [("", "", 1.0, 0.0)]
            for k in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[k : k + 50_000], columns=["feature", "tag", "last", "mean"])

    return run


def _means(rows: DataFrame, column: str, tags: list[str], shards: float) -> SequenceTagger:
    some = rows.where((F.col(column) != 0) & (F.col("feature") != "")).select("feature", "tag", (F.col(column) / shards).alias("w"))
    if some.count() > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights: fit on fewer sentences")
    t = some.toArrow()
    return SequenceTagger.of(tags, *(c.to_pylist() for c in t.columns))


def _taken(n: int, sentences: int):
    """Whether a sentence is taken, when there are n of them: by a hash, ``sentences`` at most or about that many."""
    return F.pmod(F.xxhash64(F.xxhash64("doc_id", "sent"), F.lit(1)), F.lit(1 << 30)) < int(sentences / n * (1 << 30)) if n > sentences else F.lit(True)


def fit_tagger(tokens: DataFrame, column: str = "pos", sentences: int = FIT_SENTENCES, shards: int = SHARDS, epochs: int = EPOCHS) -> SequenceTagger:
    """A tagger from a table of tagged tokens (see ``sentences_of``): at most ``sentences`` of them, by a hash.

    Its weights are the mean over all epochs of what the shards' weights were on average. A table without a tagged sentence
    gives a tagger without tags, which leaves tokens as they are.
    """
    # sentences are counted without their words, so that only the words of those that are taken are gathered
    n = tokens.where("text rlike '[^\\\\s]'").groupBy("doc_id", "sent").agg(F.bool_or(F.col(column).isNull()).alias("gap")).where("NOT gap").count()
    return _fitted(tokens.where(_taken(n, sentences)), column, shards, epochs)


def fit_on_texts(docs: DataFrame, tag: Callable[[Column], Column], tokenizer: Tokenizer | None = None, borders: Borders | None = None, sentences: int = FIT_SENTENCES, shards: int = SHARDS, epochs: int = EPOCHS) -> SequenceTagger:
    """``fit_tagger`` on the tokens of ``docs`` (doc_id, text), where ``tag`` gives a tag to every token by its text.

    Texts are gone through once to count their sentences; only those of which a sentence is taken become rows of tokens.
    """
    stash = Stash(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("text rlike '[^\\\\s]'")  # each of their sentences has a word
    counts = docs.mapInArrow(_counting(tokenizer, borders), StructType([docs.schema["doc_id"], StructField("n", IntegerType())]))
    counts = stash(counts.groupBy("doc_id").agg(F.max("n").alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    if n > sentences:
        of = counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sent")).where(_taken(n, sentences)).select("doc_id").distinct()
        docs = docs.alias("d").join(F.broadcast(of.alias("o")), F.expr("d.doc_id <=> o.doc_id"), "left_semi")  # as many as sentences are taken at most
    tokens = token_table(tokenised_documents(docs, tokenizer, borders).drop("text"))
    return _fitted(tokens.where(_taken(n, sentences)).withColumn("pos", tag(F.col("text"))), "pos", shards, epochs)


def _fitted(tokens: DataFrame, column: str, shards: int, epochs: int) -> SequenceTagger:
    spark, stash = tokens.sparkSession, Stash(tokens.sparkSession)
    dealt = stash(sentences_of(tokens, column).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards))))
    tags = sorted(r[0] for r in dealt.select(F.explode("tags").alias("t")).distinct().collect())  # a row for each tag
    model = SequenceTagger(tags)
    total: DataFrame | None = None
    for _ in range(epochs if tags else 0):
        held = spark.sparkContext.broadcast(model)
        learned = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "words").mapInPandas(_shard(held, tags), "feature string, tag string, last double, mean double")
        learned = stash(learned.groupBy("feature", "tag").agg(F.sum("last").alias("last"), F.sum("mean").alias("mean")))
        n_shards = learned.where("feature = ''").first()["last"]
        model = _means(learned, "last", tags, n_shards)
        one = learned.select("feature", "tag", (F.col("mean") / n_shards / epochs).alias("mean"))
        total = one if total is None else total.unionByName(one)
    return _means(total.groupBy("feature", "tag").agg(F.sum("mean").alias("mean")), "mean", tags, 1.0) if total is not None else model


def save_tagger(spark: SparkSession, model: SequenceTagger, path: str) -> None:
    spark.createDataFrame(pd.DataFrame(model.rows(), columns=["feature", "tag", "weight"]), MODEL).write.parquet(path)


def load_tagger(spark: SparkSession, path: str) -> SequenceTagger:
    t = spark.read.parquet(path).toArrow()
    return SequenceTagger.of(sorted(set(t["tag"].to_pylist())), *(t[c].to_pylist() for c in ("feature", "tag", "weight")))


def tag_documents(docs: DataFrame, model: SequenceTagger, column: str = "pos") -> DataFrame:
    """Documents whose tokens have the model's tags in ``column``; white space has SPACE. Other attributes stay.

    A sentence is decoded as a whole. Without tags in the model, documents come back as they are.
    """
    if not model.tags:
        return docs
    held, names = docs.sparkSession.sparkContext.broadcast(model), [*model.tags, SPACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("tokens")
            lists = batch.column(place)
            flat, n = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            words, sent = pc.struct_field(flat, "text"), np.asarray(pc.fill_null(pc.struct_field(flat, "sent"), 0))
            coded = pc.dictionary_encode(pc.fill_null(words, ""))
            is_word = np.array([bool(w) and not w.isspace() for w in coded.dictionary.to_pylist()], bool)[np.asarray(coded.indices)]
            at, unit = np.flatnonzero(is_word), np.repeat(np.arange(len(n)), n)
            at = at[np.lexsort((sent[at], unit[at]))]  # sentences one after the other, words in their order
            new = np.flatnonzero(np.r_[True, (sent[at[1:]] != sent[at[:-1]]) | (unit[at[1:]] != unit[at[:-1]])][: len(at)])
            number = np.full(len(words), len(names) - 1)
            if len(at):
                number[at] = held.value.tags_of(words.take(pa.array(at)), np.diff(np.r_[new, len(at)]))
            tags = pa.array(names, pa.string()).take(pa.array(number))
            fields = list(flat.type)
            columns = [tags if f.name == column else pc.struct_field(flat, f.name) for f in fields]
            made = pa.StructArray.from_arrays(columns, fields=fields)
            ends = np.r_[0, np.cumsum(n)].astype(np.int32)
            new = pa.ListArray.from_arrays(pa.array(ends), made, mask=pa.array(lists.is_null()) if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


#: Bytes of text that are cut and tagged at once.
PART = 4 << 20


def _counting(tokenizer: Tokenizer | None, borders: Borders | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tool, marks = tokenizer or Tokenizer(), borders or Borders()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_parts(whole, "text", PART)):
            later = later_sentences(Numbered.of(batch.column("text"), tool), marks)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) + 1 for x in later], pa.int32())], ["doc_id", "n"])

    return run


def tag_counts(docs: DataFrame, model: SequenceTagger, tokenizer: Tokenizer | None = None, borders: Borders | None = None) -> DataFrame:
    """(text, tag, n): how many tokens of the texts of ``docs`` have a text and a tag, the same as by ``tag_documents``.

    Tokens are counted by ``PART`` of text, so there are rows of equal text and tag: sum n. Without tags in the model the tag
    is null.
    """
    held, names = docs.sparkSession.sparkContext.broadcast(model), [*model.tags, SPACE if model.tags else None]
    tool, marks, k = tokenizer or Tokenizer(), borders or Borders(), len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in (part for whole in batches for part in in_parts(whole, "text", PART)):
            t = Numbered.of(batch.column("text"), tool)
            tags = np.full(len(t.numbers), k)
            words = np.flatnonzero(~t.blank[t.numbers])
            if k and len(words):
                begins, start = np.zeros(len(t.numbers) + 1, bool), np.cumsum(t.n) - t.n
                begins[start] = True
                later = later_sentences(t, marks)
                begins[np.repeat(start, [len(x) for x in later]) + np.array([i for x in later for i in x], np.int64)] = True
                sizes = np.bincount(np.cumsum(begins)[words])
                scores = decoder.scores(pa.concat_arrays([pa.array([""], pa.string()), t.words]))
                tags[words] = decoder.tags(t.numbers[words] + 1, sizes, *scores)
            counts = np.bincount(t.numbers * (k + 1) + tags, minlength=len(t.names) * (k + 1))
            some = np.flatnonzero(counts)
            made = [t.words.take(pa.array(some // (k + 1))), pa.array(names, pa.string()).take(pa.array(some % (k + 1))), pa.array(counts[some])]
            yield pa.RecordBatch.from_arrays(made, ["text", "tag", "n"])

    return docs.select("text").mapInArrow(run, "text string, tag string, n bigint")
