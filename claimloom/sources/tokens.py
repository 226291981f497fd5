"""The token store: tables of tokens, written once and read by every later stage, or made by a tagger elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import documents as D

#: A row for each token. What a tagger elsewhere doesn't know may be missing.
TABLE = "doc_id string, i int, text string, start int, space boolean, sent int, lemma string, pos string, ent_type string"


def write_tokens(docs: DataFrame, path: str) -> None:
    """Documents with tokens as a table, a row for each token, sorted by document and place in each file."""
    D.token_table(docs).sortWithinPartitions("doc_id", "i").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Documents (doc_id, tokens) of a token table. kind: parquet; json, a line for each token; or csv, tab-separated with a header.

    Of a table without offsets the text is taken to be its tokens with their blanks (see operators.documents).
    """
    if kind == "csv":
        # by the header's names, as columns may be missing; a quote is a token like others
        table = spark.read.options(header=True, sep="\t", quote="").csv(path)
    else:
        table = spark.read.schema(TABLE).json(path) if kind == "json" else spark.read.parquet(path)
    types = dict(c.split(" ") for c in TABLE.split(", "))
    table = table.select(*[table[c].cast(types[c]).alias(c) for c in table.columns if c in types])
    return D.documents_of(table)
