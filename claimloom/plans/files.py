"""Queries through files, and through model adapters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import models, text as T
from ..session import shared_dir, small_batches
from ..sources import amr_text, corpus, turtle
from .fixture import Fixture, with_fixtures
from .graphs import FIRST

ORACLE: dict[str, str] = {}


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def turtle_roundtrip(spark, sf_dir):
    path = _place(spark, "turtle")
    kind = F.when(F.substring_index("p", "#", -1).isin("startOffset", "endOffsetInclusive", "source", "confidenceValue"), "literal").otherwise("iri")
    t = FIRST.df(spark).withColumn("o_kind", kind).withColumn("o_type", F.when(F.col("p").endswith("#startOffset"), "http://www.w3.org/2001/XMLSchema#int"))
    turtle.write_turtle(t, path)
    return turtle.read_turtle(spark, path)


ORACLE["turtle_roundtrip"] = f"{with_fixtures(FIRST)} SELECT graph_id, s, p, o, CASE WHEN string_split(p, '#')[-1] IN ('startOffset', 'endOffsetInclusive', 'source', 'confidenceValue') THEN 'literal' ELSE 'iri' END AS o_kind, CASE WHEN p LIKE '%#startOffset' THEN 'http://www.w3.org/2001/XMLSchema#int' END AS o_type FROM fst"


def amr_text_roundtrip(spark, sf_dir):
    """Turns of conversations as sentences, a block for each."""
    path = _place(spark, "amr")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    g = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc_id"), F.col("turn").alias("n"), T.words(F.col("text")).alias("tokens"), F.concat(F.lit("(s / "), "role", F.lit(")")).alias("body"))
    amr_text.write_blocks(g, path)
    return amr_text.read_blocks(spark, path)


ORACLE["amr_text_roundtrip"] = r"SELECT 'c' || conv_id || '_' || turn AS id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+'), ' ') AS sentence, '(s / ' || role || ')' AS body FROM conversations"


def text_corpus_roundtrip(spark, sf_dir):
    """Conversations written as one text file each, by Spark, and read as a corpus."""
    path = _place(spark, "texts")
    c = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("value"))
    c.repartition("k").write.partitionBy("k").text(path)
    d = corpus.read_texts(spark, path)
    return d.select(F.trim(F.regexp_replace("text", "\n", " ")).alias("text"))


ORACLE["text_corpus_roundtrip"] = "SELECT r_name AS text FROM region"
CLAIM_FILE = Fixture("cf", "doc string, claim_id string, claim_span_text string", [("D1", "a", "it spreads"), ("D1", "b", ""), ("D2", "c", "masks")])


def claims_json_roundtrip(spark, sf_dir):
    path = _place(spark, "claims")
    c = CLAIM_FILE.df(spark).groupBy("doc").agg(F.collect_list(F.struct("claim_id", "claim_span_text")).alias("v"))
    c.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("doc", "v")))).alias("value")).write.text(path)
    return corpus.read_claims(spark, path).select("doc_id", "claim_id", "claim_span_text")


ORACLE["claims_json_roundtrip"] = f"{with_fixtures(CLAIM_FILE)} SELECT doc AS doc_id, claim_id, claim_span_text FROM cf"


def topics_file(spark, sf_dir):
    path = _place(spark, "topics")
    spark.createDataFrame([("ID\tsubtopic\ttopic\tTemplate\nC1\ts\tt\tX of Y\nC2\ts2\tt2\tX of Y",)], "value string").coalesce(1).write.text(path)
    return corpus.read_topics(spark, path)


ORACLE["topics_file"] = "SELECT * FROM (VALUES (0, 'ID', 'subtopic', 'topic', 'Template'), (1, 'C1', 's', 't', 'X of Y'), (2, 'C2', 's2', 't2', 'X of Y')) v(ord, id, subtopic, topic, template)"


def model_adapter_scores(spark, sf_dir):
    """The default scorer on each turn and the role's name, and the length of the default vector."""
    c = small_batches(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.round(models.entailment(F.col("text"), F.concat_ws(" ", "text", "role")), 4).alias("score"), F.size(models.encoder()(F.col("text"))).alias("width"))


QUERIES = {n: globals()[n] for n in [*ORACLE, "model_adapter_scores"]}
