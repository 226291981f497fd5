"""Documents as token sequences of bounded length, by first-fit decreasing in randomised groups.

Documents are tokenised and cut into pieces of at most a sequence. Pieces of a whole sequence stand alone. The rest are
dealt at random into groups of bounded size, and each group is packed by itself: pieces by falling length, each into the
first sequence with room, which a tournament tree over the sequences' free room finds.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, free_name

SEQUENCE = 2048
#: Mean number of pieces in a group: what one task packs at once.
GROUP_PIECES = 8192
#: Words whose ids a worker remembers: so many of late, and as many from before that.
WORDS_KEPT = 250_000

_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Ids of a text by a tokenizer with the normalisation and word rule of ``word_bpe_49k``.

    That tokenizer drops white space and never joins over it, so ids of a text are those of its words, which are
    remembered. A word of Latin letters and trailing marks goes to the merge model without the normaliser; all others
    go through the whole tokenizer.
    """

    SPLIT_ONLY_HERE = "\x1c\x1d\x1e\x1f"  #: Python's split divides at these, the tokenizer doesn't
    MARKS = ".,;:!?*$%&#|"
    PLAIN = re.compile(rf"([^\W\d_]+)([{MARKS}]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.byte_text = {b: chr(b) if b in printed else chr(next(others)) for b in range(256)}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        if word.isascii():
            core = word.rstrip(self.MARKS)
            tail, core = word[len(core) :], core.lower()
        else:
            m = self.PLAIN.fullmatch(word)
            core, tail = (unicodedata.normalize("NFC", m[1]).lower(), m[2]) if m and max(m[1]) < "ɐ" else ("", "")
        if not core.isalpha():  # lower case can add a mark, which is no letter
            return self.encode_whole(word)
        out = self.words.get(core) or self.older.get(core)
        if out is None:
            text = core if core.isascii() else core.encode().decode("latin-1").translate(self.byte_text)
            ids = [t.id for t in self.model.tokenize(text)]
            out = struct.pack(f"<{len(ids)}I", *ids)
        self.words[core] = out
        if not tail:
            return out
        if tail not in self.words:
            self.words[tail] = self.encode_whole(tail)
        return out + self.words[tail]

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(c in text for c in self.SPLIT_ONLY_HERE):
            return self.encode_whole(text)
        words = text.split()
        if len(self.words) > WORDS_KEPT:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older.get
        for w in set(words).difference(known):
            known[w] = older(w) or self.encode_word(w)
        return b"".join(map(known.__getitem__, words))


def encoder(path: str) -> Encoder:
    """One for each worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: by falling length (ties: as they come), into the first bin with room."""
    order = np.argsort(-lengths, kind="stable").tolist()
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)  # a node holds the most room among its bins
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sizes = lengths.tolist()
    for i in order:
        need, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """``docs`` without ``text``, a row for each piece: start, length, ids_crc32, doc_tokens and, if asked for, ids.

    ids: little-endian unsigned 32-bit.
    """
    kind = "array<struct<start:bigint,length:bigint,ids_crc32:bigint" + (",ids:binary" if with_ids else "") + ">>"

    @F.pandas_udf(kind)
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool, end, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * sequence
        for batch in texts:
            out = []
            for x in batch:
                ids = tool.encode(x) + end
                parts = [(i // 4, ids[i : i + step]) for i in range(0, len(ids), step)]
                out.append([{"start": i, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} | ({"ids": p} if with_ids else {}) for i, p in parts])
            yield pd.Series(out)

    (made,) = free_name(docs, "made")
    clash = {"start", "length", "ids", "ids_crc32", "doc_tokens", "text"}
    rows = docs.withColumn(made, cut(F.col("text")))
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash]
    last = F.element_at(F.col(made), -1)
    # explode_outer: explode would first filter on the array's size, which runs the tokenizer once more
    return rows.select(*keep, (last["start"] + last["length"]).alias("doc_tokens"), F.explode_outer(made).alias(made)).select(*keep, f"{made}.*", "doc_tokens")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE, seed: int = 23, group_pieces: int = GROUP_PIECES, with_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` with ``sequence_id`` and ``offset``: its place there, gapless from 0.

    A null text is the empty one, and an empty one is a piece of the end id alone. Equal rows are packed each by itself.
    Pieces of a full sequence get one of their own. An empty table gives an empty result. Columns of docs stay, but for
    text and those that the result names. with_ids: also ``ids`` as binary; else only their ``ids_crc32``.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("sequence_id", "offset")])
    cut = pieces_of(docs, tokenizer, end_id, sequence, with_ids)
    rid, group, b = free_name(cut, "rid", "grp", "bin")
    made = stash(cut.withColumn(rid, F.monotonically_increasing_id()))
    n = made.where(F.col("length") < sequence).count()
    groups = max(1, -(-n // group_pieces), min(256, n // 512))  # some tasks even for a small table, of pieces enough to fill sequences
    full = F.col("length") == sequence
    alone = made.where(full).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", F.col(rid) * 2 + 1)
    some = made.where(~full).withColumn(group, F.pmod(F.xxhash64(F.lit(seed), F.col(rid)), F.lit(groups)))

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(df["length"].to_numpy(np.int64), sequence)
        return df.assign(**{b: bins, "offset": offsets})

    small = f"`{rid}` bigint, `{b}` bigint, offset bigint, `{group}` bigint"
    placed = some.select(group, rid, "length").groupBy(group).applyInPandas(lambda df: fit(df.sort_values(rid, ignore_index=True))[[rid, b, "offset", group]], small)
    near = made.where(~full).join(placed.select(rid, "offset", ((F.col(group) * F.lit(1 << 24) + F.col(b)) * 2).alias("sequence_id")), rid)
    return near.unionByName(alone.select(*near.columns)).drop(rid)
