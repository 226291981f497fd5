"""Text corpora, catalogues and claim files. Everything is read and written by Spark, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CLAIM = "struct<claim_id:string,claim_span_text:string,claim_span_start:int,claim_span_end:int,sentence:string,start_char:int,segment_id:string>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one document for each file; .txt and .rsd at the end of its name are not part of the id.

    A file of no bytes gives no document.
    """
    d = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return d.select(T.stem_of_file(F.col("_metadata.file_name")).alias("doc_id"), F.col("value").alias("text"))


def read_whole(spark: SparkSession, path: str) -> str:
    """One small file, such as a pattern catalogue that people write."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, subtopic, topic, template) of a tab-separated catalogue; the header has ord 0."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")).where("line <> ''")
    f = F.split("line", "\t")
    return lines.select("ord", f[0].alias("id"), f[1].alias("subtopic"), f[2].alias("topic"), f[3].alias("template"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(ord, template) without the header."""
    return read_topics(spark, path).where("ord > 0").select("ord", "template")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of the lines that aren't empty; ord is in the order of the files' names and of their lines.

    Large files are read by several tasks: a line is ordered by its file's block, then by its place there.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    return spark.read.text(path).select(at.alias("ord"), F.col("value").alias("line")).where("line <> ''")


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of {doc_id: [claim, ...]} files, a row for each; those with an empty span text stay and can be counted."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", f"map<string,array<{CLAIM}>>").alias("m"))
    return parsed.select(F.explode("m").alias("doc_id", "claims")).select("doc_id", F.explode("claims").alias("c")).select("doc_id", "c.*")


#: A node, and what the claims of a run have, as they are written to JSON.
_NODE = "struct<qnode_id:string,text:string,start:int,stop:int,confidence:double,entity:string>"
_SLOT = ", ".join(f"{s}_text string, {s}_start int, {s}_stop int, {s}_type {_NODE}, {s}_identity {_NODE}" for s in ("x", "claimer"))
ANNOTATED = (
    "claim_id string, doc_id string, sent_id int, claim_text string, claim_sentence string, sent_start int, span_start int, span_stop int, start int, stop int, template string, topic string, subtopic string, location string, "
    f"{_SLOT}, claim_semantics array<struct<ord:int,event_id:string,qnode_id:string,text:string,span_start:int,span_stop:int,confidence:double,args:array<struct<ord:int,role:string,type:{_NODE},identity:{_NODE}>>>>"
)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Claims with their semantics from JSON lines that ``write_claims`` wrote."""
    return spark.read.schema(ANNOTATED).json(path)


def write_claims(claims: DataFrame, path: str) -> None:
    """JSON lines in the order of doc_id and claim_id, without the theories column."""
    claims.drop("theories").orderBy("doc_id", "claim_id").write.json(path)


def write_claim_texts(claims: DataFrame, path: str) -> None:
    claims.select("claim_text").write.csv(path)


def save_claims(claims: DataFrame, path: str) -> None:
    """The claim store of a stage: Parquet, which later stages read by column."""
    claims.write.parquet(path)


def load_claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_candidate_cache(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, ord, qnode, label, alias, description, score) of JSON files named after their query."""
    item = "array<struct<qnode:string,label:array<string>,alias:array<string>,description:array<string>,score:double>>"
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    key = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    c = whole.select(key.alias("cache_key"), F.posexplode(F.from_json("value", item)).alias("ord", "c")).select("cache_key", "ord", "c.*")
    empty = lambda name: F.when(F.size(F.coalesce(name, F.array().cast("array<string>"))) == 0, F.array(F.lit(""))).otherwise(F.col(name)).alias(name)
    return c.select("cache_key", "ord", "qnode", empty("label"), "alias", empty("description"), "score")


def read_verbs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct forms of a JSON list of lists."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.flatten(F.from_json("value", "array<array<string>>"))).alias("form")).distinct()


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """(freebase_id, qnode) of a two-column tab-separated file (qnode, freebase_id); the last line of an id counts."""
    f = F.split("line", "\t")
    return read_lines(spark, path).groupBy(f[1].alias("freebase_id")).agg(F.max_by(f[0], "ord").alias("qnode"))


def write_distribution(counts: DataFrame, path: str) -> None:
    counts.write.option("header", True).csv(path)
