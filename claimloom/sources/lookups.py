"""A cache of what a lookup service answered: read first, asked for what it lacks, and given the new answers.

A row is a request with its candidates, in folders by a hash of its key. Requests that failed are not kept, so that they are
asked again; an answer without candidates is kept. A job that fails leaves the cache as it was, as its files count only once
all tasks are done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

FOLDERS = 64
CANDIDATE = "qnode string, label array<string>, alias array<string>, description array<string>, score double"
_FOUND = "array<struct<" + ", ".join(":".join(c.split(" ", 1)) for c in CANDIDATE.split(", ")) + ">>"
CACHE = f"cache_key string, found {_FOUND}, folder int"


def cache_key(query):
    """The request with underscores."""
    return F.replace(query, F.lit(" "), F.lit("_"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(cache_key, found): one row for each request; of several answers, from jobs at the same time, the smallest."""
    try:
        kept = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = spark.createDataFrame([], CACHE)
    return kept.groupBy("cache_key").agg(F.min("found").alias("found"))


def ask(queries: DataFrame, load: Callable[[], Callable[[str, int], list[dict]]], size: int = 20) -> DataFrame:
    """(query, failed, found) for each query, by a client that each worker loads once; whatever it raises is a failure.

    A missing label or description is an empty text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = load()
        for df in batches:
            rows = []
            for q in df["query"]:
                try:
                    got = client(q, size)
                    found = [{"qnode": f.get("qnode"), "label": f.get("label") or [""], "alias": f.get("alias") or [], "description": f.get("description") or [""], "score": f.get("score")} for f in got]
                    rows.append((q, False, found))
                except Exception:  # noqa: BLE001  a request may fail in any way
                    rows.append((q, True, []))
            yield pd.DataFrame(rows, columns=["query", "failed", "found"])

    return queries.select("query").mapInPandas(run, f"query string, failed boolean, found {_FOUND}")


def look_up(queries: DataFrame, path: str, load: Callable[[], Callable[[str, int], list[dict]]], size: int = 20) -> tuple[DataFrame, DataFrame]:
    """Candidates (query, ord, qnode, label, alias, description, score) of the queries, and (query) of those that failed.

    What the cache under ``path`` has isn't asked again; each other request is sent once, however often it is asked for, and its
    answer appended. A null query, and one with a slash, is not sent and has no candidates.
    """
    spark = queries.sparkSession
    asked = written(queries.select("query").where("query IS NOT NULL").distinct().where(~F.contains("query", F.lit("/"))).withColumn("cache_key", cache_key(F.col("query"))))
    known = written(asked.select("cache_key").distinct().join(read_cache(spark, path), "cache_key"))
    missing = asked.join(known, "cache_key", "left_anti").groupBy("cache_key").agg(F.min("query").alias("query"))
    answers = written(ask(missing.repartition("cache_key"), load, size).withColumn("cache_key", cache_key(F.col("query"))))
    new = answers.where("NOT failed").select("cache_key", "found", F.pmod(F.xxhash64("cache_key"), F.lit(FOLDERS)).cast("int").alias("folder"))
    if not new.isEmpty():
        new.repartition("folder").write.mode("append").partitionBy("folder").parquet(path)
    found = asked.join(known.unionByName(new.select("cache_key", "found")), "cache_key")
    failed = asked.join(answers.where("failed").select("cache_key"), "cache_key", "left_semi").select("query")
    return found.select("query", F.posexplode("found").alias("ord", "c")).select("query", "ord", "c.*"), failed
