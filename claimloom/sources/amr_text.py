"""Semantic graphs in their text form: one block for each sentence, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks(graphs: DataFrame) -> DataFrame:
    """(doc_id, n, block) from (doc_id, n, tokens, body): id, sentence, then the graph."""
    text = F.concat_ws("\n", F.concat(F.lit("# ::id "), "doc_id", F.lit("_"), F.col("n").cast("string")), F.concat(F.lit("# ::snt "), F.array_join("tokens", " ")), F.col("body"))
    return graphs.select("doc_id", "n", text.alias("block"))


def write_blocks(graphs: DataFrame, path: str) -> None:
    """A folder doc_id=… for each document, blocks in order, an empty line after each."""
    b = blocks(graphs).repartition("doc_id").sortWithinPartitions("doc_id", "n")
    b.select("doc_id", F.concat("block", F.lit("\n")).alias("value")).write.partitionBy("doc_id").text(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentence, body) of the blocks of files."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    b = whole.select(F.explode(F.split("value", r"\n\s*\n")).alias("b")).where(F.col("b").contains("::id"))
    return b.select(F.regexp_extract("b", r"# ::id (\S+)", 1).alias("id"), F.regexp_extract("b", r"# ::snt ([^\n]*)", 1).alias("sentence"), F.trim(F.regexp_replace("b", r"(?m)^#.*\n?", "")).alias("body"))
