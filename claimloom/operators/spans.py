"""Span joins: exact, contained, and off by one at either end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Characters of a bin in the containment join.
BIN = 256
#: Places that a near match tries, in order: the start's offset, and the end's (fixed values). The fourth one is as
#: published data have it: its end is one below the start, so an end that is one lower alone is not found; ``symmetric``
#: replaces it.
PROBES = [("s", -1, "e", -1), ("s", -1, "e", 0), ("s", -1, "e", 1), ("s", 0, "s", -1), ("s", 0, "e", 0), ("s", 0, "e", 1), ("s", 1, "e", -1), ("s", 1, "e", 0), ("s", 1, "e", 1)]


def bins(start: Column, stop: Column, width: int = BIN) -> Column:
    return F.sequence(F.floor(start / width), F.floor(stop / width))


def exact_spans(mentions: DataFrame, spans: DataFrame) -> DataFrame:
    """Mentions (m_id, doc, m_start, m_stop) with the span (s_id, doc, s_start, s_stop) of equal ends, of several the first."""
    j = mentions.join(spans, (mentions.doc == spans.doc) & (F.col("m_start") == F.col("s_start")) & (F.col("m_stop") == F.col("s_stop")))
    return j.groupBy("m_id").agg(F.min("s_id").alias("s_id"))


def contained_spans(mentions: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Mentions with the first span, by s_id, that lies inside them.

    Mentions go to every bin that they touch, spans to the bin of their start: an equi join on document and bin, so that
    a long document is spread over its bins.
    """
    m = mentions.select("m_id", F.col("doc").alias("m_doc"), "m_start", "m_stop", F.explode(bins(F.col("m_start"), F.col("m_stop"), width)).alias("m_bin"))
    s = spans.select("s_id", "doc", "s_start", "s_stop", F.floor(F.col("s_start") / width).alias("s_bin"))
    j = m.join(s, (F.col("m_doc") == F.col("doc")) & (F.col("m_bin") == F.col("s_bin")) & (F.col("m_start") <= F.col("s_start")) & (F.col("m_stop") >= F.col("s_stop")))
    return j.groupBy("m_id").agg(F.min("s_id").alias("s_id"))


def linked_spans(mentions: DataFrame, spans: DataFrame, contained: bool = True) -> DataFrame:
    """(m_id, s_id, how) for every mention: the exact span, else the first contained one if allowed, else nulls."""
    e = exact_spans(mentions, spans).withColumnRenamed("s_id", "exact_id")
    out = mentions.select("m_id").join(e, "m_id", "left")
    if not contained:
        return out.select("m_id", F.col("exact_id").alias("s_id"), F.when(F.col("exact_id").isNotNull(), "exact").alias("how"))
    c = contained_spans(mentions, spans).withColumnRenamed("s_id", "inner_id")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("inner_id").isNotNull(), "contained")
    return out.join(c, "m_id", "left").select("m_id", F.coalesce("exact_id", "inner_id").alias("s_id"), how.alias("how"))


def near_spans(mentions: DataFrame, spans: DataFrame, symmetric: bool = False) -> DataFrame:
    """(m_id, s_id, probe): the span that the first of the nine probes finds; of several at a probe the largest s_id."""
    end = {"s": F.col("m_start"), "e": F.col("m_stop")}
    tries = [F.struct(F.lit(i).alias("probe"), (end[a] + da).alias("p_start"), (end["e" if symmetric else b] + db).alias("p_stop")) for i, (a, da, b, db) in enumerate(PROBES)]
    p = mentions.select("m_id", F.col("doc").alias("m_doc"), F.explode(F.array(*tries)).alias("t")).select("m_id", "m_doc", "t.*")
    j = p.join(spans, (F.col("m_doc") == F.col("doc")) & (F.col("p_start") == F.col("s_start")) & (F.col("p_stop") == F.col("s_stop")))
    return j.groupBy("m_id").agg(F.max(F.struct((-F.col("probe")).alias("minus"), "s_id")).alias("b")).select("m_id", "b.s_id", (-F.col("b.minus")).alias("probe"))


#: Bytes of needles that are searched at once; more are searched in several passes over the texts.
NEEDLE_BYTES = 16 << 20


def contained_texts(texts: DataFrame, needles: DataFrame, text_id: str, needle_id: str, most: int = NEEDLE_BYTES) -> DataFrame:
    """(text_id, needle_id) for each text that holds a needle as it stands; null and empty needles are in no text.

    The needles become an automaton that is broadcast and reads each text once, so no text is shuffled and a common word in
    a needle costs nothing.
    """
    rows = needles.where("needle IS NOT NULL AND needle <> ''").select(needle_id, "needle")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("needle") + 64), F.lit(0))).first()[0]
    passes = int(-(-size // (most // 2 if size > most else most))) or 1
    out = None
    for k in range(passes):
        part = rows.where(F.pmod(F.xxhash64("needle"), F.lit(passes)) == k)
        ids: dict[str, list] = {}
        for r in part.collect():
            ids.setdefault(r["needle"], []).append(r[needle_id])
        found = _searched(texts, text_id, list(ids))
        named = texts.sparkSession.createDataFrame([(i, v) for i, n in enumerate(ids) for v in ids[n]], StructType([StructField("place", IntegerType()), rows.schema[needle_id]]))
        one = found.join(F.broadcast(named), "place").select(text_id, needle_id)  # the ids of needles of ``most`` bytes
        out = one if out is None else out.unionByName(one)
    return out


def _searched(texts: DataFrame, text_id: str, needles: list[str]) -> DataFrame:
    """(text_id, place): the places in the list of the needles that each text holds."""
    held = texts.sparkSession.sparkContext.broadcast(needles)

    @F.pandas_udf(ArrayType(IntegerType()))
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for i, n in enumerate(held.value):
            tree.add_word(n, i)
        if held.value:
            tree.make_automaton()
        for part in batches:
            yield pd.Series([sorted({i for _, i in tree.iter(t)}) if t and held.value else [] for t in part], dtype=object)

    return texts.select(text_id, F.explode(search(F.col("text"))).alias("place"))


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")
