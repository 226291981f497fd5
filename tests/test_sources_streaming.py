"""Files in and out, and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import matching
from claimloom.plans import corpus as plan
from claimloom.sources import amr_text, corpus, turtle
from claimloom.streaming import claims as stream


def test_text_corpus(spark, tmp_path):
    (tmp_path / "bird.rsd.txt").write_text("Old birds.\nSing.")
    (tmp_path / "words.txt").write_text("\n")
    (tmp_path / "none.txt").write_text("")
    assert sorted(map(tuple, corpus.read_texts(spark, str(tmp_path)).collect())) == [("bird", "Old birds.\nSing."), ("words", "\n")]


def test_catalogues(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("ID\tsub\ttopic\tTemplate\nC1\ta\tb\tX is Y\r\n")
    assert [tuple(r) for r in corpus.read_templates(spark, str(tmp_path / "t.tsv")).collect()] == [(1, "X is Y")]
    (tmp_path / "v.json").write_text('[["cure", "cured"], ["cure"]]')
    assert {r.form for r in corpus.read_verbs(spark, str(tmp_path / "v.json")).collect()} == {"cure", "cured"}
    (tmp_path / "m.tsv").write_text("Q1\t/m/1\nQ2\t/m/1\nQ3\t/m/2\n")
    assert sorted(map(tuple, corpus.read_id_map(spark, str(tmp_path / "m.tsv")).collect())) == [("/m/1", "Q2"), ("/m/2", "Q3")]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "face_mask.json").write_text(json.dumps([{"qnode": "Q1", "label": ["mask"], "score": 0.5}]))
    r = corpus.read_candidate_cache(spark, str(tmp_path / "cache")).first()
    assert (r.cache_key, r.qnode, r.label, r.description) == ("face_mask", "Q1", ["mask"], [""])
    (tmp_path / "p.json").write_text(plan.PROSE_PATTERNS)
    assert len(matching.load_patterns(corpus.read_whole(spark, str(tmp_path / "p.json")))) == 3


def test_claim_files(spark, tmp_path):
    c = spark.createDataFrame([("b", "2", "x", "t"), ("a", "1", "y", None)], "doc_id string, claim_id string, claim_text string, theories string")
    corpus.write_claims(c, str(tmp_path / "j"))
    got = spark.read.json(str(tmp_path / "j"))
    assert got.columns == ["claim_id", "claim_text", "doc_id"] and got.count() == 2
    corpus.save_claims(c, str(tmp_path / "s"))
    assert corpus.load_claims(spark, str(tmp_path / "s")).count() == 2
    corpus.write_claim_texts(c, str(tmp_path / "c"))
    assert {r._c0 for r in spark.read.csv(str(tmp_path / "c")).collect()} == {"x", "y"}


TURTLE = """@prefix ex: <http://e/> . # a comment
PREFIX x: <http://x/>
ex:a a ex:Claim ; ex:p "q\\"u\\n", 'no' , 5 , -1.5e3 , true ; x:k [ ex:v "3"^^<http://t> ; ex:w "z"@en ] .
_:b1 ex:o <http://i> .
""".replace(", 'no' ", "")


def test_turtle_parts():
    got = turtle.parse(TURTLE)
    assert ("http://e/a", turtle.RDF_TYPE, "http://e/Claim", "iri", None) in got and ("http://e/a", "http://e/p", 'q"u\n', "literal", None) in got
    assert ("_:b1", "http://e/v", "3", "literal", "http://t") in got and ("http://e/a", "http://x/k", "_:b1", "bnode", None) in got
    assert [t[2] for t in got if t[1] == "http://e/p"] == ['q"u\n', "5", "-1.5e3", "true"]
    with pytest.raises(ValueError):
        turtle.parse("ex:a ex:b `")


def test_turtle_round_trip(spark, tmp_path):
    rows = [("g/1", "http://s", "http://p", 'a "b"\n\\c', "literal", "http://t"), ("g/1", "http://s", "http://p", "http://o", "iri", None), ("g 2", "http://s", "http://p", "é;.,", "literal", None)]
    t = spark.createDataFrame(rows, "graph_id string, s string, p string, o string, o_kind string, o_type string")
    turtle.write_turtle(t, str(tmp_path / "t"))
    assert sorted(map(str, turtle.read_turtle(spark, str(tmp_path / "t")).collect())) == sorted(map(str, t.collect()))


def test_graph_blocks(spark, tmp_path):
    g = spark.createDataFrame([("d", 1, ["a", "b"], "(x / y\n  :ARG0 z)"), ("d", 0, ["c"], "(q / r)")], "doc_id string, n int, tokens array<string>, body string")
    amr_text.write_blocks(g, str(tmp_path / "a"))
    assert sorted(map(tuple, amr_text.read_blocks(spark, str(tmp_path / "a")).collect())) == [("d_0", "c", "(q / r)"), ("d_1", "a b", "(x / y\n  :ARG0 z)")]


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.timestamp_seconds(F.col("doc_id") * 60)).alias("ts"))
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    patterns = matching.load_patterns(plan.PROSE_PATTERNS)
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    m = stream.stream_matches(source, patterns, plan.tagger)
    q = m.select("doc_id", "sent_id", "template", "first", "last").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = matching.matches(matching.tokenised(docs, plan.tagger), patterns).select("doc_id", "sent_id", "template", "first", "last")
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, want.collect()))


def test_windowed_counts_and_first_mentions(spark, tmp_path):
    schema = "template string, ts timestamp, doc_id string, start int, stop int"
    rows = [("X of Y", 0, "d", 1, 2), ("X of Y", 60, "d", 1, 2), ("nothing", 400, "d", 3, 4)]
    df = spark.createDataFrame(rows, "template string, s long, doc_id string, start int, stop int").select("template", F.timestamp_seconds("s").alias("ts"), "doc_id", "start", "stop")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    w = stream.windowed_topic_counts(source.select("template", "ts"), plan.TOPICS.df(spark))
    q = w.select(F.col("window.start").cast("long").alias("w"), "topic", "n").writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(["Row(w=0, topic='Relations', n=2)", "Row(w=300, topic=None, n=1)"])
    q = stream.first_mentions(source).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2


FORMS = """@base <http://b/dir/doc> . @prefix e: <http://e/> . PREFIX : <http://d/>
BASE <http://b2/x/>
e:a e:p ( e:b "two" ( ) [ e:q 3 ] ) ; e:s 'x', \'\'\'l'o
ng\'\'\', "caf\\u00e9 \\U0001F600\\t", "hi"@en-GB, "x"^^e:t ;; a e:T ; .
<rel> :p.q <#f>, <http://abs/> , -1.5, +2, .5, 1e3, 1.E2, true, _:n.1 . # a comment
[] e:p e:o . [ e:x e:y ] . _:n.1 e:esc e:a\\,b , e:%41 , : . ( 1 ) e:p "".
"""


def test_the_whole_grammar():
    got = [t[:3] + t[4:] for t in turtle.parse(FORMS, "n", "u")]
    r, x, e = turtle.RDF, turtle.XSD, "http://e/"
    want = [
        ("_:ub1", r + "first", e + "b", None), ("_:ub1", r + "rest", "_:ub2", None), ("_:ub2", r + "first", "two", None), ("_:ub2", r + "rest", "_:ub3", None), ("_:ub3", r + "first", r + "nil", None), ("_:ub3", r + "rest", "_:ub4", None),
        ("_:ub5", e + "q", "3", x + "integer"), ("_:ub4", r + "first", "_:ub5", None), ("_:ub4", r + "rest", r + "nil", None), (e + "a", e + "p", "_:ub1", None),
        *[(e + "a", e + "s", v, t) for v, t in [("x", None), ("l'o\nng", None), ("caf\u00e9 \U0001f600\t", None), ("hi", "@en-GB"), ("x", e + "t")]], (e + "a", r + "type", e + "T", None),
        *[("http://b2/x/rel", "http://d/p.q", v, t) for v, t in [("http://b2/x/#f", None), ("http://abs/", None), ("-1.5", x + "decimal"), ("+2", x + "integer"), (".5", x + "decimal"), ("1e3", x + "double"), ("1.E2", x + "double"), ("true", x + "boolean"), ("_:nn.1", None)]],
        ("_:ub6", e + "p", e + "o", None), ("_:ub7", e + "x", e + "y", None), *[("_:nn.1", e + "esc", v, None) for v in (e + "a,b", e + "%41", "http://d/")],
        ("_:ub8", r + "first", "1", x + "integer"), ("_:ub8", r + "rest", r + "nil", None), ("_:ub8", e + "p", "", None),
    ]
    assert got == want


@pytest.mark.parametrize("text", ["e:a e:b e:c .", "<a> <b> .", "<a> <b> 'x' <c> .", "'x' <b> <c> .", "<a> <b> <c>", "<a> <b> ( <c> .", '<a> <b> "\\q" .', "@prefix e <x> .", "<a b> <c> <d> .", "[ <b> <c> .", "<a> 'p' <c> ."])
def test_what_is_not_turtle(text):
    with pytest.raises(ValueError):
        turtle.parse(text)


def test_a_bad_file_is_named_and_the_others_are_read(spark, tmp_path):
    (tmp_path / "good.ttl").write_text('<a> <b> "c"@en, "d" .')
    (tmp_path / "bad.ttl").write_text("<a> <b> ( .")
    (tmp_path / "none.ttl").write_text("# nothing")
    got = turtle.read_turtle(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [("good", "a", "b", "c", "literal", "@en"), ("good", "a", "b", "d", "literal", None)]
    (bad,) = turtle.turtle_errors(spark, str(tmp_path)).collect()
    assert bad.file.endswith("/bad.ttl") and bad.error
    turtle.write_turtle(got, str(tmp_path / "out"))
    assert sorted(map(tuple, turtle.read_turtle(spark, str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_a_file_for_each_graph(spark, tmp_path, monkeypatch):
    rows = [(f"g{g}", f"http://s/{i}", "http://p", str(i), "literal", None) for g in range(40) for i in range(5 if g else 300)]
    t = spark.createDataFrame(rows, "graph_id string, s string, p string, o string, o_kind string, o_type string").repartition(7)
    turtle.write_turtle(t, str(tmp_path / "a"))
    assert len(list((tmp_path / "a").rglob("*.txt"))) == 40
    monkeypatch.setattr(turtle, "FILE_BLOCKS", 100)
    turtle.write_turtle(t, str(tmp_path / "b"))
    assert 40 <= len(list((tmp_path / "b").rglob("*.txt"))) <= 39 + 3 and turtle.read_turtle(spark, str(tmp_path / "b")).count() == len(rows)
