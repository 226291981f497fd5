"""SimHash fingerprints, BK-tree search for links within a Hamming radius, and the groups they form.

Broadcasting one tree over all fingerprints has no size bound, so the tree is sharded: by the pigeonhole rule, two
fingerprints that differ in 3 bits agree in at least one of 4 blocks of bits, so each block value is a shard, its
fingerprints meet in one task, and that task builds the shard's tree and follows only edges within the radius.
Larger tables use keys of more blocks, which keeps shards small. A shard that is still large is cut into chunks, and
each pair of chunks is searched in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import Stash, free_name

RADIUS = 3
#: Fingerprints of a shard that one task searches at once; larger shards are cut.
SHARD_ROWS = 2048
#: Fingerprints that a search follows at once.
QUERIES = 256


def fingerprints(text: bytes | None, count: int = 1) -> list[int]:
    """SimHashes of the 3-word shingles, unsigned; the shingles' hashes are mixed anew for those after the first.

    A-Z count as lower case; words are divided by ASCII white space.
    """
    words = (text or b"").lower().split()
    n = len(words) - 2
    if not words:
        return [0] * count
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if n > 0 else [b" ".join(words)]
    n = max(n, 1)
    hashes = np.fromiter((digest(x, 42) for x in shingles), np.uint64, n)
    out = []
    for k in range(count):
        ones = np.zeros(64, np.int64)
        for i in range(0, n, 1 << 16):
            h = mixed(hashes[i : i + (1 << 16)], k)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]))
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made of a hash; the hash itself for 0."""
    if not k:
        return h
    x = h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprint_column(text, count: int):
    """An array of the text's fingerprints, signed."""

    @F.pandas_udf(ArrayType(LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprints(x, count), np.uint64).view(np.int64) for x in texts])

    return of(text.cast("binary"))


class BKForest:
    """A BK-tree for each shard, built and searched level by level over arrays.

    points: fingerprints; shard: the shard of each. A child hangs on the edge of its distance to the parent.
    """

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        self.points = points
        order = np.argsort(shard, kind="stable")
        first = np.r_[True, np.diff(shard[order]) != 0] if len(order) else np.empty(0, bool)
        roots = order[first]
        self.root = np.empty(len(points), np.int64)
        self.root[order] = roots[np.cumsum(first) - 1]
        open_, at = order[~first], self.root[order[~first]]
        keys, children = [], []
        while len(open_):
            key = at * 65 + np.bitwise_count(points[open_] ^ points[at])
            uniq, lead, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(uniq)
            children.append(open_[lead])
            rest = np.ones(len(open_), bool)
            rest[lead] = False
            open_, at = open_[rest], children[-1][back][rest]
        key, child = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, children))
        by = np.argsort(key)
        self.key, self.child = key[by], child[by]

    def within(self, queries: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of query, index of point) at most radius apart; starts: the root where each query begins."""
        found_q, found_p = [], []
        q, node = np.arange(len(queries)), starts
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_p.append(node[hit])
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            node = self.child[np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
        return (np.concatenate(found_q), np.concatenate(found_p)) if found_q else (np.empty(0, np.int64),) * 2


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n points, linked by pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        rest = label[a] != label[b]
        a, b = a[rest], b[rest]
    return label


def _links(points: np.ndarray, ids: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point with a neighbour but one, its id and that of the first point of its component within the shard."""
    by = np.lexsort((points, shard))
    points, ids, shard = points[by], ids[by], shard[by]
    forest = BKForest(points, shard)
    label = np.arange(len(points))
    for i in range(0, len(points), QUERIES):  # in a shard of near copies each query meets all points
        q, p = forest.within(points[i : i + QUERIES], forest.root[i : i + QUERIES], radius)
        q = q + i
        apart = label[q] != label[p]
        if apart.any():
            step = local_roots(len(points), label[q[apart]], label[p[apart]])
            label = step[label]
    linked = label != np.arange(len(points))
    return ids[linked], ids[label[linked]]


def _search(radius: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard: whole shards are searched together, the last one waits for its rest."""
        wait: list[pd.DataFrame] = []
        held = 0

        def out(df: pd.DataFrame) -> pd.DataFrame:
            keys = df[["t", "k", "c"]].to_numpy()
            change = (keys[1:] != keys[:-1]).any(1)
            a, b = _links(df["fp"].to_numpy(np.int64).view(np.uint64), df["node"].to_numpy(np.int64), np.r_[0, np.cumsum(change)], radius)
            return pd.DataFrame({"a": a, "b": b})

        for df in batches:
            if not len(df):
                continue
            wait.append(df)
            held += len(df)
            if held < rows:
                continue
            df = pd.concat(wait, ignore_index=True)
            keys = df[["t", "k", "c"]].to_numpy()
            last = len(df) - np.argmax((keys != keys[-1]).any(1)[::-1]) if (keys != keys[-1]).any() else 0
            if last:
                yield out(df.iloc[:last])
            wait, held = [df.iloc[last:]], len(df) - last
        if held:
            yield out(pd.concat(wait, ignore_index=True))

    return run


def blocks_for(n: int) -> int:
    """Blocks that 64 bits are cut into; a key is all blocks but RADIUS."""
    return 4 if n < 1 << 22 else 5 if n < 1 << 31 else 6


def _keys(fp, blocks: int):
    """An array of (table, key): the bits of each choice of blocks that must be equal in one of the tables."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for t, choice in enumerate(combinations(range(blocks), blocks - RADIUS)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in choice)
        out.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("k")))
    return F.array(*out)


def link_fingerprints(fps: DataFrame, stash: Stash, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b), a > b, of nodes, that connect the same groups as all pairs of ``fp`` at most RADIUS bits apart.

    fps: (which, fp, node); only fingerprints of the same ``which`` are compared, each once. Within a shard each is linked
    to the first of its group there, so a large group gives as many links as it has fingerprints, and no link between
    groups is lost.
    """
    most = fps.groupBy("which").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    keyed = fps.select("which", "fp", "node", F.explode(_keys(F.col("fp"), blocks_for(most))).alias("s"))
    keyed = keyed.select("fp", "node", (F.col("which") * 64 + F.col("s.t")).alias("t"), "s.k")
    large = stash(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows))
    if large.isEmpty():
        shards = keyed.withColumn("c", F.lit(0).cast("long"))
    else:
        # chunks i <= j of a large shard meet in the task i * n + j
        n = F.coalesce(F.ceil(F.col("n") / (shard_rows // 2)), F.lit(1)).cast("long")
        i = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(i, j) * F.col("chunks") + F.greatest(i, j))
        shards = keyed.join(large, ["t", "k"], "left").withColumn("chunks", n).select("fp", "node", "t", "k", F.explode(pair).alias("c"))
    dealt = shards.repartition("t", "k", "c").sortWithinPartitions("t", "k", "c", "fp")
    found = dealt.select("t", "k", "c", "fp", "node").mapInPandas(_search(RADIUS, 50_000), "a bigint, b bigint")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected(edges: DataFrame, stash: Stash) -> DataFrame:
    """Components by alternating large-star and small-star steps: (a, b), b the smallest id of a's component.

    edges: (a, b) with a > b, each once. Only ids with an edge appear, and never the smallest id itself. Every step
    works on aggregated minima, and its joins have two plain scans below their exchanges, which lets Spark split a
    hot id. Tables of a finished round are deleted.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    e = stash(edges)
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = stash(e.join(low, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct())
        low2 = stash(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        moved = large.join(low2, F.col("a") == F.col("u")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stash(moved.unionByName(low2.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = state(after)
        stash.drop(e, low, large, low2)
        e = after
        if now == was:
            break
        was = now
    return e


def near_duplicates(docs: DataFrame, count: int = 1, shard_rows: int = SHARD_ROWS, with_text: bool = True) -> DataFrame:
    """``docs`` with ``fp`` (the first fingerprint, signed), ``component_id``, the smallest doc_id reachable over links, and
    ``component_root``, which names the group.

    Documents link if any of their ``count`` independent fingerprints differ in at most 3 bits. One alone finds nearly
    all copies that differ in a word or two; each further one finds more of those that differ in some percent of words.
    Null and empty texts, and texts of white space, have fingerprint 0 and link like any other. A group without any
    non-null doc_id gets null. Equal rows all stay. An empty table gives an empty result. Columns of the result's names
    are replaced. with_text: keep the text column.
    """
    stash = Stash(docs.sparkSession)
    node, key, fps = free_name(docs, "node_id", "node_key", "fps")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("fp", "component_id", "component_root")])
    marked = docs.withColumn(fps, fingerprint_column(F.col("text"), count))
    marked = marked.withColumns({"fp": F.get(fps, F.lit(0)), node: F.get(fps, F.lit(0)) if count == 1 else F.xxhash64(fps)})
    marked = stash(marked if with_text else marked.drop("text"))
    first = stash(marked.groupBy(node).agg(F.min("doc_id").alias("least_id"), F.min(fps).alias("fps")))
    each = first.select(F.col(node).alias("node"), F.posexplode("fps").alias("which", "fp"))
    if count == 1:  # the fingerprint is the node
        links = link_fingerprints(each, stash, shard_rows)
    else:
        held = stash(each.groupBy("which", "fp").agg(F.min("node").alias("rep")))
        links = link_fingerprints(held.withColumnRenamed("rep", "node"), stash, shard_rows)
        same = each.join(held, ["which", "fp"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        links = links.unionByName(same).distinct()
    roots = connected(links, stash).select(F.col("a").alias("x"), F.col("b").alias("root"))
    grouped = stash(first.join(roots, F.col(node) == F.col("x"), "left").select(F.col(node).alias(key), F.coalesce("root", node).alias("root"), "least_id"))
    least = stash(grouped.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "r"))
    named = stash(grouped.join(least, F.col("root") == F.col("r")).select(key, "component_id", F.col("root").alias("component_root")))
    stash.keep_only(marked, named)
    return marked.join(named, F.col(node) == F.col(key), "left").drop(key, node, fps)
