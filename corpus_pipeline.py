"""Documents to training sequences: toxic documents go, one of each group of near duplicates stays, documents with
benchmark passages go, personal values become pseudonyms, and what is left is packed into sequences of tokens.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.common import Stash, crc_mod, small_batches
from claimloom.llm.decontaminate import decontaminate
from claimloom.llm.packing import pack
from claimloom.llm.pii import pseudonymise
from claimloom.llm.queries import pii_key, tokenizer_path
from claimloom.llm.similar import keep_one_of_similar
from claimloom.llm.toxicity import fit_model, score_toxicity

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model is fitted on labels outside the held-out fifth."""
    labels = small_batches(spark).read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, fit_model(docs, labels)).where("toxicity < 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_one_of_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, small_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("found.n_hit = 0").select(docs.columns)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the text where it changed."""
    out = pseudonymise(docs, pii_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii_kinds") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = pack(docs.select("doc_id", "text"), tokenizer_path(), end_id=1, sequence=2048)
    return out.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("neardup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", replace_personal),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    stash = Stash(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        stash.keep_only(docs)  # the stage before is done with
    return STAGES[-1][1](spark, docs, sf_dir)
