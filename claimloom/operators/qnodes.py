"""Knowledge-base nodes: tables by roleset and by name, and the cascades that choose a node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from .graph import closure


def master_by_roleset(master: DataFrame) -> DataFrame:
    """(pb, ord, qnode, name) of rows with a description: roleset with a hyphen, name before _Q."""
    m = master.where((F.col("definition").isNotNull()) & (F.col("definition") != ""))
    return m.select(F.replace(F.col("pb"), F.lit("."), F.lit("-")).alias("pb"), "ord", F.col("id").alias("qnode"), F.regexp_replace("name", "_Q[0-9]+$", "").alias("name"))


def overlay_by_roleset(overlay: DataFrame) -> DataFrame:
    """(pb, qnode, name, ord): own roleset and the other ones, hyphenated; of equal (pb, qnode) the first."""
    o = overlay.where(F.col("description").isNotNull() & (F.col("description") != ""))
    one = o.select("ord", F.lit(0).alias("k"), F.col("pb_roleset").alias("pb"), "qnode", "name")
    more = o.select("ord", F.lit(1).alias("k"), F.explode("other_rolesets").alias("pb"), "qnode", "name")
    both = one.unionByName(more).where("pb IS NOT NULL AND pb <> ''").withColumn("pb", F.translate("pb", "._", "--"))
    w = Window.partitionBy("pb", "qnode").orderBy("ord", "k")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("pb", "qnode", "name", "ord")


def entity_names(overlay: DataFrame) -> DataFrame:
    """(name, qnode): of several nodes of a name the one that came in last; one seen before doesn't come in again."""
    o = overlay.where("description IS NOT NULL AND description <> ''").withColumn("name", F.lower("name"))
    first = o.groupBy("name", "qnode").agg(F.min("ord").alias("seen"))
    return first.groupBy("name").agg(F.max_by("qnode", "seen").alias("qnode"))


def most_similar(candidates: DataFrame, similarity: DataFrame) -> DataFrame:
    """(pb, qnode): highest similarity of name and roleset text, only above 0; ties and none: the first candidate."""
    c = candidates.withColumn("text", T.roleset_text(F.col("pb"))).join(similarity, ["text", "name"], "left")
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    return c.groupBy("pb").agg(F.max_by("qnode", F.struct(score.alias("s"), (-F.col("ord")).alias("o"))).alias("qnode"))


def most_general(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """(pb, qnode): the candidate that others descend from within the set.

    Edges to parents are followed inside the set, however far; of the ends that are reached the smallest id. A
    candidate named like the roleset wins at once. A set without any inner edge, or a cycle alone, gives no row.
    """
    named = candidates.where(F.col("name") == F.regexp_replace("pb", "-[0-9]+$", "")).groupBy("pb").agg(F.min("qnode").alias("exact"))
    c, p = candidates.select("pb", "qnode"), candidates.select("pb", F.col("qnode").alias("parent"))
    inner = c.join(parents, "qnode").join(p, ["pb", "parent"]).where("qnode <> parent").select("pb", "qnode", "parent").distinct()
    inner = written(inner)
    steps = inner.select(F.col("pb").alias("graph_id"), F.col("qnode").alias("a"), F.col("parent").alias("b"))
    ends = closure(steps, steps.select("graph_id", F.col("a").alias("start"))).select(F.col("graph_id").alias("pb"), F.col("s").alias("qnode")).distinct()
    tops = ends.join(inner.select("pb", "qnode").distinct(), ["pb", "qnode"], "left_anti")
    root = tops.groupBy("pb").agg(F.min("qnode").alias("root"))
    return root.join(named, "pb", "full_outer").select("pb", F.coalesce("exact", "root").alias("qnode"))


def choose(candidates: DataFrame, similarity: DataFrame, general: DataFrame | None = None) -> DataFrame:
    """(pb, qnode): the only candidate; else the most general one if asked for and there is one; else the most similar."""
    n = candidates.groupBy("pb").agg(F.count_distinct("qnode").alias("n"), F.min_by("qnode", "ord").alias("only"))
    s = most_similar(candidates, similarity).withColumnRenamed("qnode", "similar")
    out = n.join(s, "pb")
    if general is None:
        return out.select("pb", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("similar")).alias("qnode"))
    g = general.withColumnRenamed("qnode", "general")
    return out.join(g, "pb", "left").select("pb", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("general", "similar")).alias("qnode"))


def cascade(queries: DataFrame, *stages: DataFrame) -> DataFrame:
    """(m_id, qnode, stage): for each mention the first stage that knows one of its queries, and there the first query.

    queries: (m_id, ord, query) in the order they are tried; stages: tables (query, qnode).
    """
    known = None
    for k, stage in enumerate(stages):
        one = stage.select("query", "qnode").withColumn("stage", F.lit(k))
        known = one if known is None else known.unionByName(one)
    hit = queries.join(known, "query")
    return hit.groupBy("m_id").agg(F.min(F.struct("stage", "ord", "qnode")).alias("b")).select("m_id", "b.qnode", "b.stage")


def mention_queries(mentions: DataFrame, lemma: Callable[[Column], Column] = F.lower) -> DataFrame:
    """(m_id, ord, query): the whole text, then its words from the last to the first, each as its lemma before as it stands.

    lemma: of a column of texts, by default the text in lower case (operators.inflection learns others).
    """
    w = F.reverse(F.split("text", " "))
    all_ = F.concat(F.array(F.col("text")), F.when(F.size(w) > 1, w).otherwise(F.array().cast("array<string>")))
    each = mentions.select("m_id", F.posexplode(all_).alias("k", "q")).withColumn("low", lemma(F.col("q")))
    return each.select("m_id", F.explode(F.array(F.struct((2 * F.col("k")).alias("ord"), F.col("low").alias("query")), F.struct((2 * F.col("k") + 1).alias("ord"), F.col("q").alias("query")))).alias("x")).select("m_id", "x.*")
