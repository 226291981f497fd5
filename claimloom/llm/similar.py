"""Near duplicates by the share of common five-word shingles: SimHash fingerprints, BK-trees, and a direct comparison.

Two documents link if the Jaccard share of their sets of shingles is 0.8 or more. Each text has one 64-bit SimHash of its
shingles. At that share two fingerprints differ in some 10 bits, and blocks of equal bits are no key for such a radius; a
shard is therefore what shares one of BANDS band values, each made of ROWS minima of the shingles' hashes. The
fingerprints of a shard make a BK-tree, the search follows only edges within RADIUS, and what it meets is compared by the
sets themselves, of 32 bits for each shingle: two unlike shingles among a thousand meet with a chance of 0.0001.

A pair at a share of s has no shard in common with a chance of (1 - s**ROWS)**BANDS, 0.002 at 0.8; measured on pairs at
0.8 to 0.9, 0.0004 of the fingerprints differ in more bits than RADIUS.

A shard of more rows or bytes than one task holds is cut into chunks that are searched by themselves. Most of a large
group is one component after that; then only the rows outside the shard's largest component are compared with all its
rows, chunk by chunk, so that no link between components is lost and no group's pairs are all made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import Stash, free_name
from .neardup import BKForest, connected

WORDS = 5
#: The least share of common shingles, as a fraction.
SHARE = (4, 5)
BANDS, ROWS = 12, 4
RADIUS = 18
#: Rows, and bytes of shingle sets, that one chunk of a shard holds.
CHUNK_ROWS, CHUNK_BYTES = 512, 16 << 20
#: Ids that are broadcast (16 MB in a hash table) to find their rows; more are joined by exchange.
BROADCAST_IDS = 1_000_000
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different five-word shingles; a shorter text is one shingle. A-Z count as lower case."""
    words = (text or b"").lower().split()
    n = max(len(words) - WORDS + 1, 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + WORDS])) for i in range(n)), np.uint64, n))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes, signed."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed value for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _FACTORS[0] + _FACTORS[1]).min(0), out=least)
    each = least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ each[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the share of common hashes of two sets, each sorted, at least SHARE?"""
    if min(len(a), len(b)) * SHARE[1] < max(len(a), len(b)) * SHARE[0]:
        return False
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return common * SHARE[1] >= (len(a) + len(b) - common) * SHARE[0]


def links(fp: np.ndarray, shard: np.ndarray, sets: list[np.ndarray], label: np.ndarray, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of points that join the components of each shard: those of fingerprints within RADIUS and sets of SHARE.

    shard: sorted; label: the component each point is known to be in (changed here), whose points aren't compared. asks:
    points that are compared with the others of their shard, by default all with all.
    """
    points = np.arange(len(fp)) if asks is None else np.flatnonzero(~asks)
    ask = points if asks is None else np.flatnonzero(asks)
    begin, end = np.searchsorted(shard, shard), np.searchsorted(shard, shard, side="right")
    size = np.array([len(s) for s in sets])
    forest = BKForest(fp[points], shard[points])
    first = np.searchsorted(shard[points], shard[ask])
    here = first < len(points)
    here[here] = shard[points[first[here]]] == shard[ask[here]]
    ask, first = ask[here], first[here]
    out = []
    for i in range(0, len(ask), 512):
        q, p = forest.within(fp[ask[i : i + 512]], forest.root[first[i : i + 512]], RADIUS)
        q, p = ask[i : i + 512][q], points[p]
        ok = (label[q] != label[p]) & (np.minimum(size[q], size[p]) * SHARE[1] >= np.maximum(size[q], size[p]) * SHARE[0])
        if asks is None:
            ok &= p < q
        q, p = q[ok], p[ok]
        by = np.argsort(q, kind="stable")
        q, p = q[by], p[by]
        cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
        for at, to in zip(cuts, [*cuts[1:], len(q)]):
            a = q[at]
            near = p[at:to]
            near = near[label[near] != label[a]]
            while len(near):
                b, near = near[0], near[1:]
                if similar(sets[a], sets[b]):
                    out.append((int(a), int(b)))
                    mine = label[begin[a] : end[a]]
                    mine[mine == label[b]] = label[a]
                    near = near[label[near] != label[a]]
    return out


def _search(batches: Iterator[pd.DataFrame], rows: int = 20_000, most: int = 64 << 20) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard: whole shards are searched together, the last one waits for its rest."""
    wait: list[pd.DataFrame] = []
    held = used = 0

    def out(df: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, root = df[["key", "c"]].to_numpy(), df["node"].to_numpy(np.int64), df["root"].to_numpy(np.int64)
        shard = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(1))]
        label, asks = np.unique(root, return_inverse=True)[1], df["asks"].to_numpy()
        found = links(df["fp"].to_numpy(np.int64).view(np.uint64), shard, [np.frombuffer(g, np.uint32) for g in df["grams"]], label, None if asks[0] is None or asks[0] != asks[0] else asks.astype(bool))
        pairs = np.array([(nodes[a], nodes[b]) for a, b in found], np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs.max(1), "b": pairs.min(1)} if len(pairs) else {"a": pairs[:, 0], "b": pairs[:, 1]})

    for df in batches:
        if not len(df):
            continue
        wait.append(df)
        held, used = held + len(df), used + int(df["grams"].str.len().sum())
        if held < rows and used < most:
            continue
        df = pd.concat(wait, ignore_index=True)
        keys = df[["key", "c"]].to_numpy()
        other = (keys != keys[-1]).any(1)
        last = len(df) - int(np.argmax(other[::-1])) if other.any() else 0
        if last:
            yield out(df.iloc[:last])
        rest = df.iloc[last:]
        wait, held, used = [rest], len(rest), int(rest["grams"].str.len().sum())
    if held:
        yield out(pd.concat(wait, ignore_index=True))


def _searched(shards: DataFrame) -> DataFrame:
    """Links of (key, c, node, root, asks, fp, grams): only rows of the same key and c meet."""
    dealt = shards.select("key", "c", "node", "root", "asks", "fp", "grams").repartition("key", "c").sortWithinPartitions("key", "c", "fp", "node")
    return dealt.mapInPandas(_search, "a bigint, b bigint").distinct()


def _sketch(text):
    @F.pandas_udf("same string, n int, fp bigint, bands array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"same": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "bands": [bands(s) for s in sets]})

    return of(text.cast("binary"))


def _grams(text):
    @F.pandas_udf(BinaryType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in texts], dtype=object)

    return of(text.cast("binary"))


def _small(ids: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def similar_groups(nodes: DataFrame, texts: DataFrame, stash: Stash, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(a, b): each node of a group but its smallest, and the smallest.

    nodes: (node, n, fp, bands), texts: (node, text) with the texts of these nodes at least.
    """
    keyed = stash(nodes.select("node", "n", F.explode("bands").alias("key")))
    sizes = stash(keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum(4 * F.col("n").cast("long")).alias("bytes")).where("rows > 1"))
    open_ = stash(keyed.join(sizes, "key").select("key", "node", F.ceil(F.greatest(F.col("rows") / chunk_rows, F.col("bytes") / chunk_bytes)).cast("long").alias("chunks")))
    wanted = stash(nodes.select("node", "fp").join(open_.select("node").distinct(), "node", "left_semi"))
    held = stash(texts.join(_small(wanted), "node").select("node", "fp", _grams(F.col("text")).alias("grams")))
    full = lambda df: df.join(held, "node")
    chunk = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    alone = full(open_).select("*", chunk(F.col("chunks"), 1).alias("c"), F.col("node").alias("root"), F.lit(None).cast("boolean").alias("asks"))
    found = stash(_searched(alone))
    roots = connected(found, stash)
    large = open_.where("chunks > 1")
    if large.isEmpty():
        return roots
    rooted = stash(large.join(roots, F.col("node") == F.col("a"), "left").select("key", "node", "chunks", F.coalesce("b", "node").alias("root")))
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("m"))
    most = each.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), (F.sum("m") - F.max("m")).alias("others")).where("others > 0")
    mixed = rooted.join(stash(most), "key").withColumn("p", F.ceil(F.col("others") / chunk_rows).cast("long"))
    # chunk p of the rows outside the main component meets chunk q of all rows in the task p * chunks + q
    told = mixed.select("key", "node", "root", F.lit(False).alias("asks"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), lambda p: p * F.col("chunks") + chunk(F.col("chunks"), 2))).alias("c"))
    asks = mixed.where("root <> main").select("key", "node", "root", F.lit(True).alias("asks"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda q: chunk(F.col("p"), 3) * F.col("chunks") + q)).alias("c"))
    more = stash(_searched(full(told.unionByName(asks))))
    return connected(found.unionByName(more).distinct(), stash)


def keep_one_of_similar(docs: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest doc_id, nulls last, of equal ones the first.

    Null and empty texts, and texts of white space, are equal. The input must be a deterministic scan, as rows are told
    apart by their place in it. An empty table gives an empty result.
    """
    stash = Stash(docs.sparkSession)
    (rid,) = free_name(docs, "rid")
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    sketch = stash(numbered.select("doc_id", F.col(rid).alias("r"), _sketch(F.col("text")).alias("s")).select("doc_id", "r", "s.*"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r")).alias("best")
    each = stash(sketch.groupBy("same").agg(F.min("r").alias("node"), best))
    nodes = stash(each.select("node").join(sketch.select(F.col("r").alias("node"), "n", "fp", "bands"), "node"))
    roots = similar_groups(nodes, numbered.select(F.col(rid).alias("node"), "text"), stash, chunk_rows, chunk_bytes)
    grouped = stash(each.join(roots, F.col("node") == F.col("a"), "left").select("same", F.coalesce("b", "node").alias("root"), "best"))
    first = grouped.groupBy("root").agg(F.min("best").alias("best"))
    kept = grouped.select("same", "root").join(first, "root").select("same", F.col("best.r").alias("kept"))
    gone = stash(sketch.select("same", "r").join(kept, "same").where("r <> kept").select(F.col("r").alias(rid)))
    stash.keep_only(gone)
    return numbered.join(_small(gone), rid, "left_anti").drop(rid)
