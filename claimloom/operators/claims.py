"""Claims: topics, validity, merging of data sets, speaker and variable fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def topic_table(topics: DataFrame) -> DataFrame:
    """(key, topic, subtopic) by template: the last of equal ones counts, the header row goes, keys are trimmed and lower-cased."""
    key = F.lower(F.trim("template"))
    return topics.where("ord > 0").groupBy(key.alias("key")).agg(F.max_by("topic", "ord").alias("topic"), F.max_by("subtopic", "ord").alias("subtopic"))


def assign_topics(claims: DataFrame, topics: DataFrame) -> DataFrame:
    """``claims`` with topic and subtopic by their template; without an entry both are null.

    The catalogue is a few dozen lines of a file that people write; Spark broadcasts it by its size.
    """
    t = topic_table(topics)
    return claims.join(t, F.lower(F.trim("template")) == F.col("key"), "left").drop("key")


#: Templates whose vectors a task holds at once, and parts that the sentences are dealt to for each such block.
TEMPLATE_BLOCK, PARTS = 10_000, 64


def nearest_template(sentences: DataFrame, templates: DataFrame, n_templates: int | None = None, block: int = TEMPLATE_BLOCK) -> DataFrame:
    """(id, template_id, score): of each sentence vector ``v`` the template vector ``t`` of highest cosine, ties by id.

    Up to ``block`` templates become one array that every row is compared with, so there is no join of all pairs. More are
    cut into blocks; the sentences meet each block, dealt to PARTS tasks, and the best of all blocks counts.
    """
    n = n_templates if n_templates is not None else templates.count()
    scored = F.transform(F.col("all"), lambda x: F.struct((-F.round(T.cosine(F.col("v"), x["t"]), 6)).alias("minus"), x["template_id"].alias("template_id")))
    best = F.array_min(scored).alias("b")
    array = F.array_sort(F.collect_list(F.struct("template_id", "t"))).alias("all")
    if n <= block:
        found = sentences.withColumn("all", templates.agg(array).scalar()).select("id", best)
    else:
        k = -(-n // block)
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        blocks = templates.withColumn("block", F.pmod(F.xxhash64("template_id"), F.lit(k)).cast("int")).groupBy("block").agg(array).select("*", numbers(PARTS).alias("part"))
        dealt = sentences.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"), numbers(k).alias("block"))
        found = dealt.join(blocks, ["block", "part"]).select("id", best).groupBy("id").agg(F.min("b").alias("b"))
    return found.select("id", F.col("b.template_id").alias("template_id"), (-F.col("b.minus")).alias("score"))


def valid_fraction(claims: DataFrame, *by: str) -> DataFrame:
    """Claims, those whose span text isn't empty, and their share; a group without claims doesn't occur."""
    ok = F.col("claim_span_text").isNotNull() & (F.col("claim_span_text") != "")
    return claims.groupBy(*by).agg(F.count("*").alias("n_claims"), F.count_if(ok).alias("n_valid"), F.round(F.avg(ok.cast("int")), 6).alias("valid_share"))


def usable_sentences(claims: DataFrame, raw: str = "claim_sentence", marker: str = "data-image-title") -> DataFrame:
    """Claims whose source isn't markup and whose sentence and text have more than one word."""
    return claims.where(~F.col(raw).contains(marker) & (F.size(T.words(F.col("claim_sentence"))) > 1) & (F.size(T.words(F.col("claim_text"))) > 1))


def merge_claims(claims: DataFrame, key: str, order: str, scalars: list[str], first_wins: list[str]) -> DataFrame:
    """One row for each key: of ``scalars`` the last value that isn't null, of ``first_wins`` the first one."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first_wins]
    return claims.groupBy(key).agg(*last, *first)


def valid_semantics(events: DataFrame) -> DataFrame:
    """Events with a qnode, a span of two numbers and a text that says something."""
    return events.where(F.col("qnode_id").isNotNull() & F.col("span_start").isNotNull() & F.col("span_stop").isNotNull() & (F.col("text") != "Unspecified"))


def join_arguments(tags: DataFrame, *keys: str) -> DataFrame:
    """Words of each argument tag joined in order."""
    return tags.groupBy(*keys, "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("words"))


def variable_from_roles(template_args: DataFrame, claim_args: DataFrame) -> DataFrame:
    """(claim_id, x_text): the claim's argument of the tag that holds "this" in its template; the first such tag."""
    tag = template_args.where(F.lower("words") == "this").groupBy("claim_id").agg(F.min("tag").alias("tag"))
    return tag.join(claim_args, ["claim_id", "tag"]).select("claim_id", "tag", F.col("words").alias("x_text"))


def truthy_score(score: Column) -> Column:
    """A missing score, and one of 0, count as 1."""
    return F.when(score.isNull() | (score == 0), 1.0).otherwise(score)
