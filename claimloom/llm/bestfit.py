"""Documents in as few sequences of bounded length as possible, by bulk-synchronous best fit.

Pieces of one length are alike to a packer, and so are sequences with equal room that were filled alike: both travel as
runs (size, first number, count), so the tables of a round are bounded by the number of sizes, whatever the number of
documents. Lengths are taken in falling classes. In a round the runs of documents are sorted into ranges of length and
the gaps into ranges of size; the ranges' volumes, a few numbers, decide how many gaps of each go to which range of
documents, and a gap's rank in its range says which one gets it. Each range then sweeps its documents by falling
length, every one into its successor, the smallest gap that it fits. What finds none meets the gaps that are left in
another round, and opens sequences after that. The rounds' placements are tables of runs, too; a piece finds its place by
its length and its rank among all pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, free_name
from .packing import pieces_of

SEQUENCE = 4096
#: Ranges of length that are swept at once.
RANGES = 8
#: A range's documents fill so many sequences at least, or it is swept with its neighbour: each may leave one half empty.
LEAST_SEQUENCES = 64
#: Lengths up to 1/2, 1/3, ... of a sequence make classes; those below the last make one.
CLASSES = (2, 3, 4, 8, 32)
#: Ranks among the pieces of one length stay below 2 to this.
RANK_BITS = 40
#: kind 0: documents (size: their length; first: rank of the first among all of that length), 1: gaps (first: number of the
#: first sequence), 2: placements: document ``first + i`` is put in sequence ``seq + i // each`` at ``at + (i % each) * size``.
RUNS = "kind int, size bigint, first bigint, n bigint, seq bigint, each bigint, at bigint"
COLUMNS = [c.split()[0] for c in RUNS.split(", ")]


def class_edges(sequence: int) -> list[int]:
    """Falling upper bounds of the classes, and 0."""
    return sorted({sequence, 0, *[sequence // k for k in CLASSES]}, reverse=True)


def deal_gaps(gaps: pd.DataFrame, shares: list[tuple[int, int, int]]) -> pd.DataFrame:
    """The gap runs of one range of sizes with ``to``, the range of documents that gets them (-1: none).

    shares: (volume from, volume to, range of documents). A gap belongs to the share that holds the volume of the smaller
    gaps before it.
    """
    out, before = [], 0
    for size, first, n in gaps.sort_values(["size", "first"])[["size", "first", "n"]].itertuples(index=False):
        done = 0
        for start, end, to in [*shares, (shares[-1][1] if shares else 0, None, -1)]:
            upto = n if end is None else min(n, max(done, -(-(end - before) // size)))  # gaps that begin before the share's end
            if upto > done:
                out.append((1, size, first + done, upto - done, to))
                done = upto
        before += size * n
    return pd.DataFrame(out, columns=["kind", "size", "first", "n", "to"])


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], sequence: int, new: int | None) -> list[tuple]:
    """Best fit of document runs (length, first, n) into gap runs (size, first, n), by falling length.

    new: number of the next sequence that may be opened where none fits (None: such documents are left over). Returns
    rows of RUNS: documents left over, gaps left over and placements.
    """
    rows, room = [], sorted(gaps)

    def put(length: int, first: int, n: int, size: int, seq: int, each: int) -> None:
        """n documents, ``each`` in a sequence, the last possibly fewer, into sequences from seq on that have this room."""
        rows.append((2, length, first, n, seq, each, sequence - size))
        full, rest = divmod(n, each)
        for count, at, used in ((full, seq, each), (1 if rest else 0, seq + full, rest)):
            if count and size > used * length:
                insort(room, (size - used * length, at, count))

    for length, first, n in sorted(docs, reverse=True):
        while n:
            i = bisect_left(room, (length,))
            if i < len(room):
                size, seq, m = room.pop(i)
                each = size // length
                take = min(m, n // each) * each or n  # whole sequences, or all that are left into one
                used = -(-take // each)
                if m > used:
                    insort(room, (size, seq + used, m - used))
                put(length, first, take, size, seq, each)
                first, n = first + take, n - take
            elif new is None:
                rows.append((0, length, first, n, None, None, None))
                n = 0
            else:
                each = sequence // length
                put(length, first, n, sequence, new, each)
                new, n = new + -(-n // each), 0
    return rows + [(1, size, seq, m, None, None, None) for size, seq, m in room]


def shares_of(wanted: dict[int, int], there: dict[int, int]) -> dict[int, list[tuple[int, int, int]]]:
    """For each range of gaps the volumes that go to ranges of documents: to each its own, then the next larger gaps."""
    free, out = {r: 0 for r in there}, {r: [] for r in there}
    for p in sorted(wanted):
        need = wanted[p]
        for r in sorted((r for r in there if r <= p), reverse=True):
            take = min(need, there[r] - free[r])
            if take > 0:
                out[r].append((free[r], free[r] + take, p))
                free[r], need = free[r] + take, need - take
    return out


def _dealer(shares: dict[int, list[tuple[int, int, int]]]):
    def deal(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        return deal_gaps(df, shares.get(key[0], []))

    return deal


def _sweeper(sequence: int, new: int | None):
    """Sweeps a range of documents with its gaps; range r opens sequences from new + (r << RANK_BITS) on. Range -1 stays as it is."""

    def fit(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return df[["kind", "size", "first", "n"]].reindex(columns=COLUMNS).astype({c: "Int64" for c in COLUMNS[4:]})
        docs, gaps = ([tuple(map(int, x)) for x in df[df["kind"] == k][["size", "first", "n"]].to_numpy()] for k in (0, 1))
        rows = sweep(docs, gaps, sequence, None if new is None else new + (int(key[0]) << RANK_BITS))
        return pd.DataFrame(rows, columns=COLUMNS).astype({"kind": "int32"} | {c: "Int64" for c in COLUMNS[1:]})

    return fit


def joined_ranges(wanted: dict[int, int], least: int, ranges: int) -> list[int]:
    """For each range the first of those that it is swept with: neighbours, until they hold this volume of documents."""
    out, held = [0], 0
    for r in range(1, ranges):
        held += wanted.get(r - 1, 0)
        out.append(r if held >= least and sum(v for k, v in wanted.items() if k >= r) >= least else out[-1])
        held = 0 if out[-1] == r else held
    return out


def _summed(volumes: dict[int, int], first: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for r, v in volumes.items():
        to = first[r] if r >= 0 else r
        out[to] = out.get(to, 0) + v
    return out


def place_runs(runs: DataFrame, sequence: int = SEQUENCE, ranges: int = RANGES, stash: Stash | None = None) -> list[DataFrame]:
    """Placements (RUNS, kind 2) of all document runs (kind 0, one for each length), a table for each round."""
    stash = stash or Stash(runs.sparkSession)
    edges, left, placed, number = class_edges(sequence), stash(runs), [], 0
    for high, low in zip(edges, edges[1:], strict=False):
        width = max(1, -(-(high - low) // ranges))
        fine = F.greatest(F.lit(-1), F.floor((F.lit(high) - F.col("size")) / width)).cast("int")
        for opens in (False, True):
            volumes = left.where(F.col("size") > low).groupBy("kind", fine.alias("r")).agg(F.sum(F.col("size") * F.col("n")).alias("v")).collect()  # two numbers a range
            wanted, there = ({v["r"]: v["v"] for v in volumes if v["kind"] == k} for k in (0, 1))
            if not wanted:
                break
            if not there and not opens:
                continue
            first = joined_ranges(wanted, LEAST_SEQUENCES * sequence, ranges)
            wanted, there = (_summed(v, first) for v in (wanted, there))
            r = F.when(fine < 0, fine).otherwise(F.element_at(F.array(*map(F.lit, first)), fine + 1))
            now = left.where(F.col("size") > low).select("kind", "size", "first", "n", r.alias("to"))
            gaps = now.where("kind = 1").groupBy("to").applyInPandas(_dealer(shares_of(wanted, there)), "kind int, size bigint, first bigint, n bigint, to int")
            rest = left.where(F.col("size") <= low).select("kind", "size", "first", "n", F.lit(-1).alias("to"))
            swept = stash(now.where("kind = 0").unionByName(gaps).unionByName(rest).groupBy("to").applyInPandas(_sweeper(sequence, number << RANK_BITS if opens else None), RUNS))
            number += ranges
            placed.append(swept.where("kind = 2"))
            left = swept.where("kind < 2")
    return placed


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE, ranges: int = RANGES, with_ids: bool = True) -> DataFrame:
    """Pieces of all ``docs`` with ``piece`` (from 0), ``start``, ``length``, ``sequence_id`` and ``offset``, gapless from 0.

    A document is its text's ids and the end id; only one longer than a sequence is cut, into whole sequences and a rest. A
    null text is the empty one, and an empty one is a piece of the end id alone. Equal rows are packed each by itself. An
    empty table gives an empty result. Columns of docs stay, but for text and those that the result names. with_ids: also
    ``ids`` (little-endian unsigned 32-bit); else only their ``ids_crc32``.
    """
    spark, stash = docs.sparkSession, Stash(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("piece", "sequence_id", "offset")])
    cut = pieces_of(docs, tokenizer, end_id, sequence, with_ids)
    rid, part, rank, earlier, place = free_name(cut, "rid", "part", "rank", "earlier", "place")
    made = stash(cut.withColumns({rid: F.monotonically_increasing_id(), part: F.spark_partition_id()}))
    counts = stash(made.groupBy(part, "length").agg(F.count("*").alias("n")))
    runs = counts.groupBy("length").agg(F.sum("n").alias("n")).select(F.lit(0).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), "n", *[F.lit(None).cast("long").alias(c) for c in COLUMNS[4:]])
    # as many rows as the rounds have runs, however many documents there are
    placements = pd.concat([x.toPandas() for x in place_runs(runs, sequence, ranges, stash)] or [pd.DataFrame(columns=COLUMNS)]).sort_values(["size", "first"])
    table = spark.sparkContext.broadcast(tuple(placements[c].to_numpy(np.int64) for c in ("size", "first", "seq", "each", "at")))

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, first, seq, each, at = table.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = np.searchsorted((size << RANK_BITS) + first, (length << RANK_BITS) + rank, side="right") - 1
        i = rank - first[row]
        return pd.DataFrame({"sequence_id": seq[row] + i // each[row], "offset": at[row] + (i % each[row]) * length})

    before = counts.withColumn(earlier, F.sum("n").over(Window.partitionBy("length").orderBy(part)) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy(part, "length").orderBy(rid)) - 1
    ranked = made.withColumn(rank, nth).join(before, [part, "length"]).withColumn(rank, F.col(rank) + F.col(earlier))
    out = ranked.withColumn(place, find("length", rank)).withColumn("piece", F.floor(F.col("start") / sequence).cast("int"))
    keep = [F.col(f"`{c}`") for c in cut.columns]
    return out.select(*keep, "piece", f"{place}.*")
