"""What Python holds at once doesn't grow with the table."""

import numpy as np
import pyarrow as pa

from claimloom.functions import adapters, models
from claimloom.functions import tokens as TK
from claimloom.plans import corpus, files, meaning


def test_a_parser_gets_few_sentences_at_once(spark):
    def load():
        def parse(sentences):
            return [([("n", str(len(sentences)))], [], [], "n") for _ in sentences]

        return parse

    df = spark.range(1000).selectExpr("cast(id AS string) AS graph_id", "array('a') AS tokens").coalesce(1)
    rows = adapters.parse_graphs(df, load)["nodes"].collect()
    assert len({r.graph_id for r in rows}) == 1000 and max(int(r.label) for r in rows) <= adapters.SENTENCES


def test_a_model_gets_few_texts_at_once(spark):
    df = spark.range(1000).selectExpr("cast(id AS string) AS t").coalesce(1)
    score = models.scorer(lambda: lambda a, b: np.array([float(x) if x == y else -1.0 for x, y in zip(a, b, strict=True)]) + (len(a) > models.TEXTS))
    width = models.encoder(lambda: lambda texts: np.full((len(texts), 2), len(texts), np.float32))
    rows = df.select("t", score("t", "t").alias("s"), width("t").alias("v")).collect()
    assert [(r.t, r.s) for r in rows] == [(str(i), float(i)) for i in range(1000)] and max(r.v[0] for r in rows) <= models.TEXTS


def test_tokens_are_made_of_few_texts_at_once():
    texts = ["a b. " * 20_000, None, "", "c"] * 40
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(160)), "text": texts})
    out = list(TK.tokenising(["doc_id"])(iter([batch])))
    assert max(len(b.column("tokens").flatten()) for b in out) < 12 * 60_000
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(160))


def test_queries_read_small_batches(spark, sf):
    for query in (corpus.template_containment, meaning.parser_adapter, files.model_adapter_scores):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        query(spark, sf)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
