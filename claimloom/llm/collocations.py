"""Collocations: phrases of two or three words that occur together more than their parts suggest.

Three scans of the texts, whatever their size. The first counts the words, and pairs and triples of words by hashed
buckets. The second counts the candidates among pairs: those of frequent words whose buckets are full enough. The third
counts the candidates among triples: those whose pairs are frequent, as the second scan has it, and whose buckets are full
enough. A frequent phrase always is one. Each task sums its own candidates and deals them to shares by a hash; a share
numbers its candidates by a minimal perfect hash, whose slots hold their keys, and adds the tasks' counts by slot. Only
frequent phrases leave a share, and a phrase's parts are joined to it.

A word's key is 64 bits of its language and itself, under a salt for which no two words of the corpus share a key. So keys
of phrases, the keys of their words, are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

MIN_COUNT = 10
TOP = 2000
#: Candidates that a share has at most on average, over all tasks that met them; more make more shares.
SLOTS = 1_000_000
#: Bits of the table of frequent pairs for each of them, and the most that it has, as a power of two.
PAIR_BITS, MOST_PAIR_BITS = 16, 29
#: Parts in which a language's phrases are ranked before they meet.
RANKED = 64
#: Buckets for pairs and as many for triples, as a power of two; tables of bits for words.
BUCKET_BITS, WORD_BITS = 26, 26
#: What half a byte holds: a bucket's count stops there or at the least count of a phrase.
HALF_BYTE = 15
#: Words that a task numbers before it starts anew. Three numbers below 2 to the PACKED are packed into one.
VOCABULARY, PACKED = 600_000, 21
#: Numbers of a table in one row, and rows that are summed into one in a round.
BLOCK, FAN = 1 << 16, 32
#: Candidates that a task gathers before it joins equal ones.
GATHERED = 4_000_000

_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", b"abcdefghijklmnopqrstuvwxyz "))
_TABLE = _LOWER.translate(bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10))
_U = np.uint64


def word_prefix(lang: str, salt: int) -> bytes:
    return f"{salt}:{len(lang.encode())}:{lang}".encode()


def spark_word_key(lang, word, salt: int):
    """The key of a word in Spark: XXH64 with seed 42, as ``Vocabulary`` has it."""
    return F.xxhash64(F.concat(F.lit(f"{salt}:"), F.octet_length(lang).cast("string"), F.lit(":"), lang, word))


class Vocabulary(dict):
    """Numbers of the words of one language, from 1; 0 ends a piece."""

    def __init__(self, lang: str, salt: int):
        super().__init__({b".": 0})
        self.lang, self.prefix = lang, word_prefix(lang, salt)
        self._keys, self._known = [0], np.zeros(0, _U)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self._keys.append(xxhash.xxh64_intdigest(self.prefix + word, 42))
        return n

    def numbers(self, texts: list[str]) -> np.ndarray:
        words = ".".join(texts).encode().translate(_TABLE).replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def keys(self) -> np.ndarray:  # type: ignore[override]
        """The words' keys by number."""
        if len(self._keys) > len(self._known):
            self._known = np.r_[self._known, np.array(self._keys[len(self._known) :], _U)]
        return self._known


def numbered(batches: Iterator[pa.RecordBatch], salt: int, limit: int) -> Iterator[tuple[Vocabulary, np.ndarray, bool]]:
    """(vocabulary, numbers, ends) for the texts of each language in each batch; ends: the vocabulary isn't used any more."""
    own: dict[str, Vocabulary] = {}
    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            if lang not in own:
                own[lang] = Vocabulary(lang, salt)
            yield own[lang], own[lang].numbers(some), False
        if sum(map(len, own.values())) > limit:
            for v in own.values():
                yield v, np.empty(0, np.int64), True
            own = {}
    for v in own.values():
        yield v, np.empty(0, np.int64), True


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of two 64-bit numbers in order."""
    x = a * _U(0x9E3779B97F4A7C15) + b * _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def windows(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pair, and whether a triple, of words of one piece begins at each place."""
    word = numbers > 0
    pair = word[:-1] & word[1:]
    return pair, pair[:-1] & word[2:]


class BitTable:
    """Bits that are addressed by the leading bits of a hash."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.shift = packed, _U(64 - bits)

    def has(self, hashed: np.ndarray) -> np.ndarray:
        at = hashed >> self.shift
        return (self.packed[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0


class PhraseSlots:
    """A minimal perfect hash of phrases, as three columns of word keys (0 where a phrase is shorter), with the keys kept by slot.

    Each level is a table of bits, two for each key that is left: a key alone at its place stays there, the others go on to
    the next level. A key's slot is the number of bits before its own.
    """

    def __init__(self, keys: np.ndarray, per_key: int = 2):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        slots, rest, first = np.empty(len(keys), np.int64), np.arange(len(keys)), 0
        h, g = self._hashes(*keys.T) if len(keys) else (np.empty(0, _U),) * 2
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("the same phrase twice")
            size = -(-per_key * len(rest) // 64) * 64
            at = self._place(h[rest], g[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(_U)
            before = first + np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))][:-1]
            self.levels.append((size, words, before))
            stay = alone[at]
            slots[rest[stay]] = self._rank(words, before, at[stay])
            first, rest = first + int(stay.sum()), rest[~stay]
        self.keys = np.empty((3, len(keys)), _U)
        self.keys[:, slots] = keys.T

    def __len__(self) -> int:
        return self.keys.shape[1]

    @staticmethod
    def _hashes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(mixed(a, b), c)
        return h, mixed(h, a ^ c) | _U(1)

    @staticmethod
    def _place(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(h + _U(level) * g, g) % _U(size)).astype(np.int64)

    @staticmethod
    def _rank(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = words[word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))
        return before[word] + np.bitwise_count(below)

    def find(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Slots of phrases; -1 for those that have none."""
        h, g = self._hashes(a, b, c)
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(rest):
                break
            at = self._place(h[rest], g[rest], level, size)
            here = (words[at >> 6] >> (at & 63).astype(_U)) & _U(1) > 0
            out[rest[here]] = self._rank(words, before, at[here])
            rest = rest[~here]
        if len(self):
            same = (self.keys[0][out] == a) & (self.keys[1][out] == b) & (self.keys[2][out] == c)
            out[~same] = -1
        return out


def in_halves(numbers: np.ndarray) -> np.ndarray:
    """Numbers up to 15, two to a byte."""
    return numbers[::2] | numbers[1::2] << 4


def from_halves(data: np.ndarray) -> np.ndarray:
    return np.stack([data & 15, data >> 4], axis=1).ravel()


def add_to_halves(table: np.ndarray, at: np.ndarray, n: np.ndarray, most: int) -> None:
    """Adds to numbers at different places of a table of half bytes, up to ``most``."""
    for odd in (0, 1):
        here = (at & 1) == odd
        byte, shift = at[here] >> 1, 4 * odd
        old = table[byte]
        new = np.minimum((old >> shift & 15) + n[here], most).astype(np.uint8)
        table[byte] = old & (0x0F if odd else 0xF0) | new << shift


def _blocks(table: np.ndarray, which: int, size: int = BLOCK) -> dict[str, list]:
    """Blocks of a table that aren't all zero, compressed; size: of a block, in the table's numbers."""
    part, out = TaskContext.get().partitionId() if TaskContext.get() else 0, {"which": [], "block": [], "part": [], "counts": []}
    for k in range(0, len(table), size):
        if table[k : k + size].any():
            for c, v in zip(out, (which, k // size, part, pa.compress(table[k : k + size].tobytes(), codec="zstd", asbytes=True)), strict=True):
                out[c].append(v)
    return out


def unpacked(data: bytes, kind: str, size: int) -> np.ndarray:
    """The numbers of a block; kind i8, or u4 for half bytes."""
    if kind == "u4":
        return from_halves(np.frombuffer(pa.decompress(data, size // 2, codec="zstd", asbytes=True), np.uint8))
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def tree_sum(rows: DataFrame, parts: int, kind: str, sizes: dict[int, int], most: int | None = None, fan: int = FAN) -> DataFrame:
    """Blocks (which, block, part, counts) summed over ``fan`` neighbouring parts at a time until each is one row.

    kind: i8 or u4 (half bytes); most: sums stop there. sizes: the length of each table.
    """

    def add(df: pd.DataFrame) -> pd.DataFrame:
        which, block = int(df["which"].iloc[0]), int(df["block"].iloc[0])
        n = min(BLOCK, sizes[which] - block * BLOCK)
        total = np.zeros(n, np.int64)
        for data in df["counts"]:
            total += unpacked(data, kind, n)
        if most:
            total = np.minimum(total, most)
        packed = pa.compress((in_halves(total.astype(np.uint8)) if kind == "u4" else total).tobytes(), codec="zstd", asbytes=True)
        return pd.DataFrame({"which": [which], "block": [block], "part": [int(df["part"].iloc[0]) // fan], "counts": [packed]})

    while True:
        rows = rows.groupBy("which", "block", F.floor(F.col("part") / fan).alias("into")).applyInPandas(add, "which int, block int, part int, counts binary")
        parts = -(-parts // fan)
        if parts <= 1:
            return rows


def count_words_and_buckets(docs: DataFrame, salt: int, bits: int = BUCKET_BITS, least: int = MIN_COUNT, limit: int = VOCABULARY) -> DataFrame:
    """First scan. Rows (lang, word, n) with which null, and blocks of buckets of pairs (which 2) and triples (which 3).

    Buckets count up to ``least``, or 15 if that is less, so half a byte is enough.
    """
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("which", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def fill(table: np.ndarray, hashed: list[np.ndarray]) -> None:
        at, n = np.unique(np.concatenate(hashed) >> _U(64 - bits), return_counts=True)
        add_to_halves(table, at.astype(np.int64), np.minimum(n, HALF_BYTE), min(least, HALF_BYTE))
        hashed.clear()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros(1 << bits - 1, np.uint8) for k in (2, 3)}
        waiting: dict[int, list[np.ndarray]] = {2: [], 3: []}
        counts: dict[int, np.ndarray] = {}
        for vocab, numbers, ends in numbered(batches, salt, limit):
            if ends:
                n, words = counts.pop(id(vocab)), list(vocab)
                for k in range(1, len(words), 100_000):
                    some = words[k : k + 100_000]
                    yield rows(lang=[vocab.lang] * len(some), word=[w.decode() for w in some], n=n[k : k + 100_000])
                continue
            n = np.bincount(numbers, minlength=len(vocab))
            if id(vocab) in counts:
                n[: len(counts[id(vocab)])] += counts[id(vocab)]
            counts[id(vocab)] = n
            keys = vocab.keys()[numbers]
            pair, triple = windows(numbers)
            two = mixed(keys[:-1], keys[1:])
            waiting[2].append(two[pair])
            waiting[3].append(mixed(two[:-1], keys[2:])[triple])
            for k, some in waiting.items():
                if sum(map(len, some)) > GATHERED // 4:
                    fill(tables[k], some)
        for k, some in waiting.items():
            if some:
                fill(tables[k], some)
            if tables[k].any():
                yield rows(**_blocks(tables[k], k, BLOCK // 2))

    return docs.mapInArrow(scan, "lang string, word string, n bigint, which int, block int, part int, counts binary")


def kept_windows(vocab: Vocabulary, numbers: np.ndarray, frequent: BitTable, full: dict[int, BitTable]) -> tuple[np.ndarray, ...]:
    """Keys, numbers of frequent words (else 0), pairs' hashes, and the places of pairs and of triples that may be frequent."""
    good = frequent.has(vocab.keys())
    good[0] = False
    keys, kept = vocab.keys()[numbers], np.where(good[numbers], numbers, 0)
    pair, triple = windows(kept)
    two = mixed(keys[:-1], keys[1:])
    pair &= full[2].has(two)
    at = np.flatnonzero(triple & pair[:-1] & pair[1:])
    return keys, kept, two, np.flatnonzero(pair), at[full[3].has(mixed(two[at], keys[at + 2]))]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers with the sums of their counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    some, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(some, kind="stable")
    some, n = some[order], n[order]
    first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]][: len(some)])
    return some[first], np.add.reduceat(n, first) if len(first) else n


def find_candidates(docs: DataFrame, salt: int, words, buckets, shares: int, limit: int = VOCABULARY, lengths: tuple[int, ...] = (2, 3)) -> DataFrame:
    """The candidates of these lengths that a task met, a row for each language and share of their hashes.

    keys: their keys k1, k2, k3 (0 for a pair), column after column; counts: how often the task met each. words: broadcast
    BitTable of frequent words; buckets: broadcast BitTables of pairs (2) and triples (3). A task that has gathered many
    hands them on and begins anew, so it never holds all of its candidates.
    """
    schema = pa.schema([("lang", pa.string()), ("share", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def rows(vocab: Vocabulary, numbers: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = vocab.keys()[numbers.T]
        share = (mixed(mixed(keys[0], keys[1]), keys[2]) % _U(shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        ends = np.cumsum(np.bincount(share, minlength=shares))
        some = [(k, order[a:b]) for k, (a, b) in enumerate(zip(np.r_[0, ends], ends, strict=False)) if a < b]
        columns = [[vocab.lang] * len(some), [k for k, _ in some], [keys[:, at].tobytes() for _, at in some], [counts[at].tobytes() for _, at in some]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def unpack(packed: np.ndarray) -> np.ndarray:
        return np.stack([(packed >> s) & ((1 << PACKED) - 1) for s in (2 * PACKED, PACKED, 0)], axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, full = words.value, buckets.value
        met: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for vocab, numbers, ends in numbered(batches, salt, limit):
            own = met.setdefault(id(vocab), [])
            if ends:
                some, n = _summed(*map(list, zip(*met.pop(id(vocab)), strict=True))) if own else _summed([], [])
                yield from rows(vocab, unpack(some), n)
                continue
            _, kept, _, pair, triple = kept_windows(vocab, numbers, frequent, full)
            new = {2: (kept[pair], kept[pair + 1], np.zeros(len(pair), np.int64)), 3: (kept[triple], kept[triple + 1], kept[triple + 2])}
            if len(vocab) >> PACKED:  # texts of more words than can be packed
                yield from rows(vocab, *np.unique(np.concatenate([np.stack(new[k], axis=1) for k in lengths]), axis=0, return_counts=True))
                continue
            own += [np.unique(a << 2 * PACKED | b << PACKED | c, return_counts=True) for a, b, c in (new[k] for k in lengths)]
            if sum(len(k) for k, _ in own) > GATHERED:
                own[:] = [_summed(*map(list, zip(*own, strict=True)))]
                if len(own[0][0]) > GATHERED // 2:
                    some, n = own.pop()
                    yield from rows(vocab, unpack(some), n)

    return docs.mapInArrow(scan, "lang string, share int, keys binary, counts binary")


def counted(met: DataFrame, least: int) -> DataFrame:
    """(k1, k2, k3, a, two): the phrases of ``find_candidates`` that occur ``least`` times or more; two: the hash of a pair's keys."""

    def count(df: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, _U).reshape(3, -1) for x in df["keys"]], axis=1)
        n = np.concatenate([np.frombuffer(x, np.int64) for x in df["counts"]])
        order = np.lexsort(keys[::-1])
        new = np.r_[True, (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)]
        table = PhraseSlots(keys[:, order[new]].T)
        total = np.zeros(len(table), np.int64)
        np.add.at(total, table.find(*keys), n)
        k1, k2, k3 = table.keys[:, total >= least]
        return pd.DataFrame({"k1": k1.view(np.int64), "k2": k2.view(np.int64), "k3": k3.view(np.int64), "a": total[total >= least], "two": mixed(k1, k2).view(np.int64)})

    return met.groupBy("share").applyInPandas(count, "k1 bigint, k2 bigint, k3 bigint, a bigint, two bigint")


def with_parts(pairs: DataFrame, triples: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, k1, k2, k3, a, head1, tail1, head2, tail2): frequent phrases with the counts of their first words, and of those
    after them (2: of triples only). words: lang, key, n; parts of a frequent phrase are as frequent, so all are there.
    """
    none = F.lit(0).cast("long")
    first = words.select(F.col("key").alias("k1"), "lang", F.col("n").alias("head1"))
    last = words.select(F.col("key").alias("last"), F.col("n").alias("n_last"))
    both = lambda a, b, n: pairs.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("a").alias(n))
    two = pairs.join(first, "k1").join(last, F.col("k2") == F.col("last")).select("lang", "k1", "k2", "k3", "a", "head1", F.col("n_last").alias("tail1"), none.alias("head2"), none.alias("tail2"))
    three = triples.join(both("k1", "k2", "head2"), ["k1", "k2"]).join(both("k2", "k3", "tail1"), ["k2", "k3"]).join(first, "k1").join(last, F.col("k3") == F.col("last"))
    return two.unionByName(three.select("lang", "k1", "k2", "k3", "a", "head1", "tail1", "head2", F.col("n_last").alias("tail2")))


def _collected_bits(blocks: DataFrame, which: int, bits: int, least: int) -> BitTable:
    """A bit for each bucket that holds ``least``: that much comes to the driver."""
    size = 1 << bits

    @F.pandas_udf("binary")
    def full(counts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(unpacked(x, "u4", min(BLOCK, size)) >= min(least, HALF_BYTE), bitorder="little").tobytes() for x in counts])

    packed = np.zeros(max(1, size // 8), np.uint8)
    for block, data in blocks.where(F.col("which") == which).select("block", full("counts")).collect():
        some = np.frombuffer(data, np.uint8)
        packed[block * (BLOCK // 8) : block * (BLOCK // 8) + len(some)] = some
    return BitTable(packed, bits)


def _word_bits(keys: DataFrame, bits: int) -> BitTable:
    """A table of bits of the words' keys, of a size that doesn't depend on their number."""
    at = F.shiftrightunsigned("key", 64 - bits)

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        here = np.zeros(BLOCK, bool)
        here[df["at"].to_numpy(np.int64) % BLOCK] = True
        return pd.DataFrame({"block": [int(df["at"].iloc[0]) // BLOCK], "data": [np.packbits(here, bitorder="little").tobytes()]})

    places = keys.select(at.alias("at")).distinct()
    packed = np.zeros(max(1 << bits, BLOCK) // 8, np.uint8)
    for block, data in places.groupBy(F.floor(F.col("at") / BLOCK)).applyInPandas(pack, "block long, data binary").collect():
        packed[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(data, np.uint8)
    return BitTable(packed, bits)


def count_phrases(docs: DataFrame, least: int = MIN_COUNT, slots: int = SLOTS, bits: int = BUCKET_BITS, limit: int = VOCABULARY, stash: Stash | None = None) -> tuple[DataFrame, DataFrame]:
    """(phrases, words) of ``docs`` (lang, text).

    phrases: lang, k1, k2, k3 and the counts of ``with_counts`` for every phrase of two or three words that occurs ``least``
    times or more in its language. words: lang, word, key, n, for all words.
    """
    spark, stash = docs.sparkSession, stash or Stash(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    sizes, salt = {2: 1 << bits, 3: 1 << bits}, 0
    while True:
        found = stash(count_words_and_buckets(docs, salt, bits, least, limit))
        words = found.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = stash(words.withColumn("key", spark_word_key(F.col("lang"), F.col("word"), salt)))
        if not words.groupBy("key").count().where("count > 1 or key = 0").head(1):
            break
        salt += 1
    blocks = found.where("which is not null").select("which", "block", "part", "counts")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    full = stash(tree_sum(blocks, parts, "u4", sizes, most=min(least, HALF_BYTE)))
    stash.drop(found)
    frequent = words.where(F.col("n") >= least)
    word_bits = spark.sparkContext.broadcast(_word_bits(frequent, WORD_BITS))
    buckets = spark.sparkContext.broadcast({k: _collected_bits(full, k, bits, least) for k in (2, 3)})

    # a scan has no more candidates than words, so a share has ``slots`` of them at most, give or take
    total = words.agg(F.sum("n")).first()[0] or 0
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // slots))
    pairs = stash(counted(find_candidates(docs, salt, word_bits, buckets, shares, limit, (2,)), least))
    pair_bits = min(MOST_PAIR_BITS, max(BLOCK.bit_length(), (PAIR_BITS * pairs.count()).bit_length()))
    held = spark.sparkContext.broadcast({2: _word_bits(pairs.select(F.col("two").alias("key")), pair_bits), 3: buckets.value[3]})
    triples = stash(counted(find_candidates(docs, salt, word_bits, held, shares, limit, (3,)), least))
    return stash(with_parts(pairs, triples, frequent)), words


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, slots: int = SLOTS, bits: int = BUCKET_BITS) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    ``docs``: lang (null: und), text (null: empty); other columns are ignored. A-Z are lower-cased; pieces end at .,;:!? and
    line ends, words at blanks and tabs. a: occurrences of the phrase, l and r: of its two parts at the cut with the lowest
    score, the first of equals; n: words of the language; score: floor(1000000 * a * a / (l * r)). A pair is left out if a
    triple that holds it occurs half as often or more. Equal scores go by falling a, then by the phrase. Copies count as
    often as they are there. An empty table gives no row.
    """
    stash = Stash(docs.sparkSession)
    phrases, words = count_phrases(docs, least, slots, bits, stash=stash)
    score = lambda k: F.expr(f"cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * cast(1000000 as decimal(7,0)) div (cast(head{k} as decimal(18,0)) * cast(tail{k} as decimal(18,0)))")
    longer = phrases.where("k3 != 0")
    holds = longer.select(F.explode(F.array(F.struct("k1", "k2"), F.struct(F.col("k2").alias("k1"), F.col("k3").alias("k2")))).alias("p"), "a")
    holds = holds.groupBy("p.k1", "p.k2").agg(F.max("a").alias("held")).withColumn("k3", F.lit(0).cast("long"))
    kept = phrases.join(holds, ["k1", "k2", "k3"], "left").where("held is null or 100 * held < 50 * a")
    kept = kept.withColumn("s1", score(1)).withColumn("s2", F.when(F.col("k3") != 0, score(2)))
    second = F.col("s2") < F.col("s1")
    cut = {"score": F.when(second, F.col("s2")).otherwise(F.col("s1")), "l": F.when(second, F.col("head2")).otherwise(F.col("head1")), "r": F.when(second, F.col("tail2")).otherwise(F.col("tail1"))}
    ranked = kept.withColumns(cut).select("lang", "k1", "k2", "k3", "a", "l", "r", "score")
    # by parts first, so that no task has all phrases of a language; equals stay until they are spelled
    part = F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(RANKED))
    best = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"))
    ranked = ranked.withColumn("part", part).withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place")
    spelled = words.where(F.col("n") >= least).select("key", "word")
    for k in (1, 2, 3):
        ranked = ranked.join(spelled.select(F.col("key").alias(f"k{k}"), F.col("word").alias(f"w{k}")), f"k{k}", "left")
    ranked = ranked.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    inside = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
