"""Counts and ratios over claims, and comparisons of claim sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import objects, of_type


def slot_ratios(claims: DataFrame, slots: list[str], parts: list[str]) -> DataFrame:
    """One row: claims, and for each slot its share of the claims and each part's share of the slot; null over none."""
    out = [F.count("*").alias("n_claims")]
    for s in slots:
        n = F.count(s)
        out.append(F.round(F.try_divide(n.cast("double"), F.count("*")), 6).alias(f"{s}_share"))
        out += [F.round(F.try_divide(F.count_if(F.col(s).isNotNull() & F.col(f"{s}_{p}").isNotNull()).cast("double"), n), 6).alias(f"{s}_{p}_share") for p in parts]
    return claims.agg(*out)


def entity_histogram(slots: DataFrame) -> DataFrame:
    """One row from (ent_id), a row for each open variable, claimer and argument: slots, entities, those with more than one
    mention, mentions, the most of one entity, and the share of slots that are mentions of one; null over none.
    """
    h = slots.groupBy("ent_id").agg(F.count("*").alias("n"))
    known = F.col("ent_id").isNotNull()
    n = F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))
    out = h.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_slots"), F.count("ent_id").alias("n_entities"), F.count_if(known & (F.col("n") > 1)).alias("n_repeated"), n.alias("n_mentions"), F.max(F.when(known, F.col("n"))).alias("most"))
    return out.withColumn("mention_share", F.round(F.try_divide(F.col("n_mentions").cast("double"), F.col("n_slots")), 6))


def overlap_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs of claims of a document with equal spans, and with equal sentences. Counted, not listed.

    Both sides are counted by key first, so that a sentence that many claims share costs one row on each side.
    """

    def pairs(keys: list[str], name: str) -> DataFrame:
        x, y = a.groupBy(*keys).agg(F.count("*").alias("x")), b.groupBy(*keys).agg(F.count("*").alias("y"))
        return x.join(y, keys).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias(name))

    return pairs(["doc_id", "start", "stop"], "same_span").select("same_span", F.lit(1).alias("k")).join(pairs(["doc_id", "sentence"], "same_sentence").withColumn("k", F.lit(1)), "k").drop("k")


def added_elements(merged: DataFrame, marker: str) -> DataFrame:
    """(claim, uri, kind) of the semantics of claims whose IRI holds the first system's marker: events, else entities."""
    claims = of_type(merged, "aida:Claim").withColumnRenamed("s", "claim")
    uri = F.col("uri")
    kind = F.when(uri.contains("events"), "events").when(uri.contains("entity"), "entities")
    return objects(merged, "aida:claimSemantics", "uri", "claim").join(claims, ["graph_id", "claim"], "left_semi").where(uri.contains(marker)).select("claim", "uri", kind.alias("kind")).where("kind IS NOT NULL").distinct()


def merge_report(merged: DataFrame, marker: str) -> DataFrame:
    """(claim, events, entities): what the merge added to each claim that it changed, sorted, joined by blanks."""
    added = added_elements(merged, marker)
    of = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("uri")))), " ")
    return added.groupBy("claim").agg(of("events").alias("events"), of("entities").alias("entities"))


def merge_totals(first: DataFrame, second: DataFrame, merged: DataFrame, marker: str) -> DataFrame:
    """One row: claims, claims that the merge changed, events and entities added, and clusters of a claim's semantics whose
    prototype is one of the second store's events and entities.
    """
    added = added_elements(merged, marker)
    n = of_type(merged, "aida:Claim").agg(F.count("*").alias("n_claims"))
    k = added.agg(F.count_distinct("claim").alias("n_modified"), F.count_if(F.col("kind") == "events").alias("n_events"), F.count_if(F.col("kind") == "entities").alias("n_entities"))
    theirs = of_type(second, "aida:Entity", "aida:Event").join(of_type(first, "aida:Entity", "aida:Event"), ["graph_id", "s"], "left_anti").withColumnRenamed("s", "found")
    mine = of_type(first, "aida:SameAsCluster").withColumnRenamed("s", "cluster")
    found = objects(merged, "aida:prototype", "found", "cluster").join(theirs, ["graph_id", "found"], "left_semi").join(mine, ["graph_id", "cluster"], "left_semi")
    r = objects(merged, "aida:claimSemantics", "cluster", "claim").join(found.select("graph_id", "cluster").distinct(), ["graph_id", "cluster"], "left_semi").agg(F.count("*").alias("n_replaced"))
    one = F.lit(1).alias("k")
    return n.select("*", one).join(k.select("*", one), "k").join(r.select("*", one), "k").drop("k")


def qnode_accuracy(claims: DataFrame, judgments: DataFrame, *by: str) -> DataFrame:
    """Share of good qnodes among those judged (qnode, good 0/1)."""
    return claims.join(judgments, "qnode").groupBy(*by).agg(F.count("*").alias("n_judged"), F.round(F.avg("good"), 6).alias("accuracy"))
