"""Candidates for a query text: filtering, deduplication, ranking, options, expansion of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

THRESHOLD = 0.01


def filtered(candidates: DataFrame) -> DataFrame:
    """Items whose first label or any alias holds the query as it stands, that have a description and a Q id."""
    hit = F.get("label", F.lit(0)).contains(F.col("query")) | F.coalesce(F.exists("alias", lambda a: a.contains(F.col("query"))), F.lit(False))
    return candidates.where(F.coalesce(hit, F.lit(False)) & F.get("description", F.lit(0)).isNotNull() & F.col("qnode").startswith("Q"))


def deduplicated(candidates: DataFrame) -> DataFrame:
    """Of equal (query, first label, first description) the first one."""
    key = ["query", F.coalesce(F.get("label", F.lit(0)), F.lit("")), F.coalesce(F.get("description", F.lit(0)), F.lit(""))]
    return candidates.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))).where("__k = 1").drop("__k")


def top_k(scored: DataFrame, k: int = 3, by: str = "query", threshold: float = THRESHOLD) -> DataFrame:
    """The k best of each query with a score of at least the threshold; ties in the given order."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") >= threshold))


def exclude_options(options: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct options, and distinct others that no option of the query names."""
    o = options.select("query", "qnode").distinct()
    rest = others.select("query", "qnode").distinct().join(o, ["query", "qnode"], "left_anti")
    return o.withColumn("list", F.lit("options")).unionByName(rest.withColumn("list", F.lit("other")))


def pick(options: DataFrame) -> DataFrame:
    """(query, qnode): the first option, else the first other one, else the first of all by list and order."""
    rank = F.when(F.col("list") == "options", 0).when(F.col("list") == "other", 1).otherwise(2)
    return options.groupBy("query").agg(F.min_by("qnode", F.struct(rank.alias("r"), "ord")).alias("qnode"))


def verb_lemmas(tokens: DataFrame, verbs: DataFrame) -> DataFrame:
    """(query, lemma, weight): tagged verbs with weight 1, then other tokens that are verb forms with 0.9; the higher counts."""
    forms = verbs.select(F.explode("forms").alias("form")).distinct()
    tagged = tokens.where("pos = 'VERB'").select("query", "lemma", F.lit(1.0).alias("weight"))
    known = tokens.where("pos <> 'VERB'").join(forms, F.col("lemma") == F.col("form"), "left_semi").select("query", "lemma", F.lit(0.9).alias("weight"))
    return tagged.unionByName(known).groupBy("query", "lemma").agg(F.max("weight").alias("weight"))


def participle(verb):
    """Present participle by spelling: e falls before ing, ie becomes y, a short last consonant doubles."""
    return (
        F.when(verb.endswith("ie"), F.concat(F.regexp_replace(verb, "ie$", ""), F.lit("ying")))
        .when(verb.rlike("[^aeiouy]e$") | verb.rlike("ue$"), F.concat(F.regexp_replace(verb, "e$", ""), F.lit("ing")))
        .when(verb.rlike("^[^aeiou]*[aeiou][bdgklmnprt]$"), F.concat(verb, F.right(verb, F.lit(1)), F.lit("ing")))
        .otherwise(F.concat(verb, F.lit("ing")))
    )


def lookup(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates from a cache keyed by the query with underscores, and the queries that it lacks. A query with a slash has none."""
    key = F.replace(F.col("query"), F.lit(" "), F.lit("_"))
    q = queries.select("query").distinct().where(~F.col("query").contains("/")).withColumn("cache_key", key)
    return q.join(cache, "cache_key").drop("cache_key"), q.join(cache, "cache_key", "left_anti").select("query")
