"""The lookup cache: what is asked, what is kept, and what is asked again."""

import pytest

from claimloom.sources import lookups


def service(log, broken):
    """A client that notes its requests in a folder and fails for some."""

    def load():
        import os
        import uuid

        def client(query, size):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(query)
            if query in broken:
                raise OSError("no answer")
            return [] if query == "nothing" else [{"qnode": f"Q{len(query)}", "label": [query], "score": 0.5}, {"qnode": "Q0"}][:size]

        return client

    return load


def asked(log):
    return sorted(f.read_text() for f in log.iterdir())


def test_answers_are_kept_and_failures_asked_again(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "cache")
    log.mkdir()
    queries = spark.createDataFrame([("red cat",), ("red_cat",), ("red cat",), ("nothing",), ("down",), ("a/b",), (None,)], "query string")
    found, failed = lookups.look_up(queries, path, service(str(log), {"down"}))
    rows = sorted((r.query, r.ord, r.qnode, r.label, r.description, r.score) for r in found.collect())
    assert rows == [(q, k, *c) for q in ("red cat", "red_cat") for k, c in enumerate([("Q7", ["red cat"], [""], 0.5), ("Q0", [""], [""], None)])]
    assert [r.query for r in failed.collect()] == ["down"] and asked(log) == ["down", "nothing", "red cat"]
    # a second run asks only what failed
    found, failed = lookups.look_up(queries, path, service(str(log), set()))
    assert found.count() == 6 and failed.count() == 0 and asked(log) == ["down", "down", "nothing", "red cat"]
    found, failed = lookups.look_up(queries.union(spark.createDataFrame([("new",)], "query string")), path, service(str(log), set()))
    assert found.count() == 8 and asked(log) == ["down", "down", "new", "nothing", "red cat"]
    assert lookups.read_cache(spark, path).count() == 4


def test_two_answers_count_once(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "log"
    log.mkdir()
    q = spark.createDataFrame([("x",)], "query string")
    lookups.look_up(q, path, service(str(log), set()))
    spark.read.parquet(path).write.mode("append").partitionBy("folder").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").partitionBy("folder").parquet(path + "2")
    assert lookups.read_cache(spark, path + "2").count() == 1
    found, _ = lookups.look_up(q, path + "2", service(str(log), {"x"}))
    assert found.count() == 2


def test_an_empty_table_asks_nothing(spark, tmp_path):
    found, failed = lookups.look_up(spark.createDataFrame([], "query string"), str(tmp_path / "none"), service("/nowhere", set()))
    assert found.count() == failed.count() == 0 and not (tmp_path / "none").exists()


def test_a_job_that_fails_leaves_the_cache(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "log"
    log.mkdir()
    lookups.look_up(spark.createDataFrame([("x",)], "query string"), path, service(str(log), set()))

    def load():
        raise RuntimeError("no client")

    with pytest.raises(Exception, match="no client"):
        lookups.look_up(spark.createDataFrame([("x",), ("y",)], "query string"), path, load)
    assert lookups.read_cache(spark, path).count() == 1
