"""Uniform shuffle of a table into shards of exact size, by a hypergeometric communication matrix.

Of a uniform permutation, only how many rows of each input partition go to each shard matters before the exchange; those
counts are multivariate hypergeometric. Each input partition finds its own row of that matrix by descending a binary tree
over partitions, with one number for each shard at every level, so neither the driver nor an executor holds the matrix.
The rows of a partition are permuted to take these shards. After the exchange each shard is permuted: every row has a
random place key, the leading bits of the key are the block that one task sorts, and the blocks' sizes give the slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, free_name

#: numpy's generator accepts populations below this size.
NUMPY_LIMIT = 1_000_000_000


def _log_pmf(k, good: int, bad: int, n: int) -> float:
    lf = lambda x: math.lgamma(x + 1)
    return -(lf(k) + lf(good - k) + lf(n - k) + lf(bad - n + k))


def hypergeometric(g: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows, drawn without replacement, are good. Beyond numpy's limit by ratio of uniforms."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    if good < NUMPY_LIMIT and bad < NUMPY_LIMIT:
        return int(g.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    spread = math.sqrt(max(1e-9, mean * (bad / total) * ((total - n) / (total - 1))) + 0.5)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    top, width = _log_pmf(mode, good, bad, n), 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = g.random(), g.random()
        if u == 0:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= _log_pmf(k, good, bad, n) - top:
            return k


def split_margins(g: np.random.Generator, margins: np.ndarray, n: int) -> np.ndarray:
    """Of n rows drawn without replacement from blocks of these sizes, how many come from each block."""
    total = int(margins.sum())
    if total < NUMPY_LIMIT:
        return g.multivariate_hypergeometric(margins, n, method="marginals")
    if len(margins) == 1:
        return np.array([n])
    half = len(margins) // 2
    first = int(margins[:half].sum())
    k = hypergeometric(g, first, total - first, n)
    return np.concatenate([split_margins(g, margins[:half], k), split_margins(g, margins[half:], n - k)])


def matrix_row(part: int, ends: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix. ends: running sum of the partitions' row counts, from 0."""
    lo, hi, margins = 0, len(ends) - 1, sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_margins(np.random.default_rng([seed, lo, hi]), margins, int(ends[mid] - ends[lo]))
        lo, hi, margins = (lo, mid, left) if part < mid else (mid, hi, margins - left)
    return margins


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard: they differ by one at most."""
    return rows // shards + (np.arange(shards) < rows % shards)


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 17, rows_per_block: int = 65536, least_blocks: int = 3072) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (the row's place in its shard, gapless from 0).

    The permutation is uniform over rows and depends on the seed and on how the input is partitioned, so a lost task
    gets the same rows again. The input must be a deterministic scan (write a shuffled one to a table first); a partition
    with more or fewer rows in one pass than in the other raises.

    Nulls, empty and equal rows count as rows like any other. An empty table gives an empty result. Columns named
    shard or slot are replaced. Shards differ by one row at most; with fewer rows than shards the last ones are empty.
    """
    rid, block, order, drawn, before = free_name(docs, "rid", "block", "place", "drawn", "before")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")], F.monotonically_increasing_id().alias(rid))
    part = F.shiftright(F.col(rid), 33)
    counts = {r[0]: r[1] for r in docs.groupBy(part.alias("p")).count().collect()}  # one number for each input partition
    ends = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(max(counts, default=0) + 1)])])
    rows = int(ends[-1])
    per_shard = max(-(-least_blocks // shards), -(-rows // (shards * rows_per_block)))
    held = docs.sparkSession.sparkContext.broadcast(ends)  # one number for each input partition

    @F.pandas_udf("int")
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, labels, seen = -1, np.empty(0, np.int32), 0
        for ids in batches:
            values = ids.to_numpy(np.int64)
            for p in np.unique(values >> 33):
                if at >= 0 and p != at:
                    raise ValueError("rows of several partitions in one task")
                if p != at:
                    row = matrix_row(int(p), held.value, shard_sizes(rows, shards), seed)
                    at, labels = int(p), np.random.default_rng([seed, 1 << 40, int(p)]).permutation(np.repeat(np.arange(shards, dtype=np.int32), row))
            seen += len(values)
            yield pd.Series(labels[values & ((1 << 33) - 1)])
        if seen != len(labels):
            raise ValueError(f"partition {at}: {seen} rows, {len(labels)} before; the input must be a deterministic scan")

    dealt = docs.withColumn(drawn, draw(F.col(rid))).withColumn(order, F.xxhash64(F.lit(seed), F.col(rid)))
    dealt = dealt.withColumn(block, F.floor(F.col(order).bitwiseAND(F.lit((1 << 62) - 1)) / F.lit((1 << 62) / per_shard)).cast("int"))
    # how many rows lie in the blocks before: a row for each block, numbered within its shard
    sizes = Stash(docs.sparkSession)(dealt.groupBy(F.col(drawn).alias("shard"), F.col(block).alias("b")).agg(F.count("*").alias("n")))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", F.col("b").alias(before + "_b"), F.coalesce(first, F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(drawn, block).orderBy(F.col(order).bitwiseAND(F.lit((1 << 62) - 1)), rid)).cast("long") - 1
    placed = dealt.withColumn("slot", place).join(F.broadcast(starts) if per_shard * shards <= 1 << 20 else starts, (F.col(drawn) == F.col("shard")) & (F.col(block) == F.col(before + "_b")))
    return placed.withColumn("slot", (F.col(before) + F.col("slot")).cast("long")).drop(rid, block, order, drawn, before, before + "_b")
