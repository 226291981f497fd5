"""The trie of conversations that begin alike, from partial tries of partitions that are merged by node.

A node is a sequence of turns, known by 128 bits: the exclusive or, over its turns, of hashes of place and turn. So a
conversation's nodes are a running sum over its turns, however long it is, and a parent is its child without the last turn.
Conversations are dealt into ranges of ids. Each partition combines its rows to a table of nodes, tables of neighbouring
partitions are merged by node, a fixed number at a time, until one is left. A conversation's turns are summed from its
end upwards, each node's own value being entered once, at its smallest member, and the same merge adds those sums: that
gives every subtree's total in one pass, with no round for a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash

#: Tables of so many partitions become one in a round.
FAN = 16
#: A node's children are spread over so many keys where they look for their parent.
SALTS = 256
WORD = r"[^\x20\x09-\x0D]+"
HEADS = 3


def turns_of(conversations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, ``place`` (from 0), ``digest`` of role and text, ``words`` of the text, and the columns in ``keep``.

    Turns are ordered by turn (null first), then role, then the text's MD5; repeated rows are turns of their own. A null
    role or text is the empty one. Rows without conv_id belong to no conversation and go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("__turn"), role.alias("__role"), F.unhex(F.md5(text.cast("binary"))).alias("__md5"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), *[(role if c == "role" else text if c == "text" else F.col(f"`{c}`")).alias(c) for c in keep],
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("__turn").asc_nulls_first(), "__role", "__md5")
    return rows.withColumn("place", F.row_number().over(order) - 1).drop("__turn", "__role", "__md5")


def rebuilt(turns: DataFrame, block: int = 20, heads: int = HEADS) -> DataFrame:
    """Conversations that share beginnings: the first h turns of conversation c - c % block, then c's own after its first h.

    h is crc32 of the decimal id modulo heads + 1. ``turns`` are those of ``turns_of``; the result has ``depth`` (from 1)
    for ``place``. A conversation that is left without a turn has one row of depth 0 with nulls.
    """
    rest = [c for c in turns.columns if c not in ("conv_id", "place")]
    base = F.col("conv_id") - F.col("conv_id") % block
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (heads + 1)).alias("h"))
    there = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("base_n"))
    convs = convs.join(there, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    shared = convs.join(first, "base").where("place < h").select("conv_id", (F.col("place") + 1).cast("long").alias("depth"), *rest)
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("m") + 1).cast("long").alias("depth"), *rest)
    none = convs.where("n <= h and m = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in rest])
    return shared.unionByName(own).unionByName(none)


def paths_of(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that ``prefix_trie`` takes."""
    return turns.withColumn("depth", (F.col("place") + 1).cast("long")).drop("place")


def _merged(rows: DataFrame, parts: int, sums: dict, fan: int) -> DataFrame:
    """Rows of a node, combined in each ``part``, then in ``fan`` neighbouring parts at a time, until one row a node is left."""
    while True:
        rows = rows.groupBy("x1", "x2", "part").agg(*[f(c).alias(c) for c, f in sums.items()])
        if parts <= 1:
            return rows.drop("part")
        rows, parts = rows.withColumn("part", F.floor(F.col("part") / fan).cast("int")), -(-parts // fan)


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """x1, x2 and ends_sha256; ends: x1, x2, part, conv_id, with parts in the order of their ids.

    A partition's ids of a node are one text. A node's texts pass through the hash in the order of parts, so no list is
    held whole but that of one partition.
    """
    lists = ends.groupBy("x1", "x2", "part").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for df in batches:
            out = []
            for x1, x2, ids in zip(df["x1"], df["x2"], df["ids"], strict=True):
                if at == (x1, x2):
                    state.update(b",")
                else:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (x1, x2), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["x1", "x2", "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["x1", "x2", "ends_sha256"])

    return lists.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "part").mapInPandas(stream, "x1 bigint, x2 bigint, ends_sha256 string")


def prefix_trie(paths: DataFrame, stash: Stash | None = None, fan: int = FAN) -> DataFrame:
    """One row for each distinct beginning of a conversation, the empty one (depth 0) included.

    ``paths``: conv_id, depth (1, 2, ... of each conversation, or a single row of depth 0), digest, words; further columns
    are ignored. Result: x1, x2 (the node's name), conv_id (smallest member), depth, parent_conv_id (null at depth 0),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) * words), ends_sha256. An empty table
    gives no row.
    """
    stash = stash or Stash(paths.sparkSession)
    at_root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    own = F.struct("depth", "digest", "words")
    rows = paths.select("conv_id", F.explode(F.when(F.col("depth") == 0, F.array(at_root)).when(F.col("depth") == 1, F.array(at_root, own)).otherwise(F.array(own))).alias("t")).select("conv_id", "t.*")
    order = Window.partitionBy("conv_id").orderBy("depth")
    turn = lambda k: F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "digest")).otherwise(0)
    rows = rows.repartitionByRange("conv_id").withColumns({"t1": turn(1), "t2": turn(2)})
    rows = rows.withColumns({"x1": F.bit_xor("t1").over(order), "x2": F.bit_xor("t2").over(order), "ends": F.lead("depth").over(order).isNull(), "part": F.spark_partition_id()})
    parents = {f"p{k}": F.when(F.col("depth") > 0, F.col(f"x{k}").bitwiseXOR(F.col(f"t{k}"))) for k in (1, 2)}
    rows = stash(rows.withColumns(parents).select("conv_id", "depth", "x1", "x2", "p1", "p2", "words", "ends", "part"))
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1

    same = {c: F.min for c in ("conv_id", "depth", "p1", "p2", "words")}
    nodes = _merged(rows.withColumn("n_convs", F.lit(1).cast("long")), parts, same | {"n_convs": F.sum}, fan)
    nodes = stash(nodes.withColumn("salt", F.pmod(F.col("x1"), F.lit(SALTS))))
    # a popular parent has a row for each salt, so its children meet it in many places
    family = nodes.where("depth > 0").groupBy("p1", "p2", "salt").agg(F.count("*").alias("children"))
    family = family.join(nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id")), ["p1", "p2"])
    children = family.groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.sum("children").alias("n_children"))
    nodes = nodes.join(children, ["x1", "x2"], "left").join(family.drop("children"), ["p1", "p2", "salt"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = stash(nodes.drop("p1", "p2", "salt"))

    value = [((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves")]
    entered = nodes.select("conv_id", "depth", "x1", "x2", *value, F.lit(False).alias("member"))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("saved", "leaves")]
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.select("conv_id", "depth", "x1", "x2", *nothing, F.lit(True).alias("member")).unionByName(entered)
    below = both.withColumns({c: F.sum(c).over(upward) for c in ("saved", "leaves")}).where("member").withColumn("part", F.spark_partition_id())
    sums = _merged(below, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), {"saved": F.sum, "leaves": F.sum}, fan)
    out = nodes.join(sums, ["x1", "x2"]).join(_hashed_ends(rows.where("ends")), ["x1", "x2"], "left")
    return out.select(
        "x1", "x2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def with_last_turns(trie: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie with ``role`` and ``text`` of each node's last turn (null at depth 0); ``paths`` has them (``turns_of(keep=...)``)."""
    return trie.join(paths.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")
