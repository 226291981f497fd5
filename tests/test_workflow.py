"""Stages from files to files, by the command line."""

from claimloom import cli
from claimloom.functions import vocabulary as V
from claimloom.operators import aif
from claimloom.plans import graphs, workflow
from claimloom.sources import corpus, turtle


def test_detect_to_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.one.txt").write_text("Cats eat fish. Dogs eat the big fish, cats don't.\n")
    (tmp_path / "p.json").write_text('{"X eats fish": [[{"LOWER": {"IN": ["cats", "dogs"]}}, {"LEMMA": "eat"}, {"TEXT": "the", "OP": "?"}, {"TEXT": "big", "OP": "*"}, {"TEXT": "fish"}]]}')
    (tmp_path / "t.tsv").write_text("ID\tsubtopic\ttopic\tTemplate\nC1\tdiet\tanimals\tX eats fish \n")
    cli.main(["detect", "--input", str(tmp_path / "in"), "--patterns", str(tmp_path / "p.json"), "--topics", str(tmp_path / "t.tsv"), "--out", str(tmp_path / "claims")], spark)
    rows = corpus.load_claims(spark, str(tmp_path / "claims")).orderBy("sent_id").collect()
    text = (tmp_path / "in" / "doc.one.txt").read_text()
    assert [(r.doc_id, r.claim_text, r.topic, text[r.span_start : r.span_stop]) for r in rows] == [("doc.one", "Cats eat fish", "animals", "Cats eat fish"), ("doc.one", "Dogs eat the big fish", "animals", "Dogs eat the big fish")]
    cli.main(["to-json", "--input", str(tmp_path / "claims"), "--out", str(tmp_path / "json")], spark)
    cli.main(["topics", "--input", str(tmp_path / "claims"), "--out", str(tmp_path / "counts")], spark)
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.csv(str(tmp_path / "counts"), header=True).first()["count"] == "2"
    cli.main(["overlap", "--first", str(tmp_path / "claims"), "--second", str(tmp_path / "claims")], spark)


def test_entities_and_links(spark, tmp_path):
    (tmp_path / "e.cs").write_text(":E1\ttype\thttps://o#LOC.Land\n:E1\tlink\tQ18\n:E1\tmention\t\"South\"\tD1:10-14\t1.0\n:E2\tmention\t\"x\"\tD1:3-3\t1.0\n")
    linked, orphans, ents = workflow.entity_tables(spark, str(tmp_path / "e.cs"))
    assert [(r.ent_id, r.text, r.ent_link, r.ent_type) for r in linked.collect()] == [("E1".join([":", ""]), "South", "Q18", "LOC.Land")] and orphans.count() == 1 and ents.count() == 1
    m = spark.createDataFrame([(1, "D1.rsd", 10, 14), (2, "D1", 8, 20), (3, "D2", 10, 14)], "m_id int, doc_id string, start int, stop int")
    assert sorted((r.m_id, r.ent_id, r.how) for r in workflow.link_mentions(m, linked).collect()) == [(1, ":E1", "exact"), (2, ":E1", "contained"), (3, None, None)]
    cli.main(["ingest-entities", "--input", str(tmp_path / "e.cs"), "--out", str(tmp_path / "m")], spark)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_external_claims(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"D1": [{"claim_id": "a", "claim_span_text": "x"}, {"claim_id": "b", "claim_span_text": ""}]}')
    claims, share = workflow.external_claims(spark, str(tmp_path / "c.json"))
    assert claims.count() == 1 and share.first().valid_share == 0.5


HEAD = "@prefix aida: <" + V.AIDA + "> .\n@prefix ex: <" + V.EX + "> .\n@prefix rdf: <" + V.RDF + "> .\n@prefix xsd: <" + V.XSD + "> .\n\n"
OWN = HEAD + """<http://s> a aida:System .

<http://s/D1/claim_id/77> a aida:Claim ;
    aida:sourceDocument "D1.rsd"^^xsd:string ;
    aida:claimSemantics <http://s/clusters/own/events/D1/EN_Event_000000>,
        <http://s/clusters/own/entity/D1/EN_Entity_EDL_ENG_0000001>, <http://s/clusters/own/entity/D1/EN_Entity_EDL_ENG_0000002> ;
    aida:justifiedBy <http://s/claims/justifications/D1/0/20> ;
    aida:system <http://s> .

<http://s/claims/justifications/D1/0/20> a aida:TextJustification ;
    aida:confidence [ a aida:Confidence ;
        aida:confidenceValue 1.00E+00 ;
        aida:system <http://s> ] ;
    aida:endOffsetInclusive "20"^^xsd:int ;
    aida:source "D1"^^xsd:string ;
    aida:startOffset "0"^^xsd:int ;
    aida:system <http://s> .

<http://s/clusters/own/events/D1/EN_Event_000000> a aida:SameAsCluster ;
    aida:prototype <http://s/events/own/D1/EN_Event_000000> .
<http://s/events/own/D1/EN_Event_000000> a aida:Event ;
    aida:justifiedBy <http://s/j/event> .
<http://s/j/event> a aida:TextJustification ; aida:startOffset "3"^^xsd:int ; aida:endOffsetInclusive "9"^^xsd:int ; aida:source "D1"^^xsd:string .
<http://s/clusters/own/entity/D1/EN_Entity_EDL_ENG_0000001> a aida:SameAsCluster ;
    aida:prototype <http://s/entities/own/D1/EN_Entity_EDL_ENG_0000001> .
<http://s/entities/own/D1/EN_Entity_EDL_ENG_0000001> a aida:Entity ;
    aida:justifiedBy <http://s/j/1> ;
    aida:link [ a aida:LinkAssertion ;
        aida:linkTarget "Q1"^^xsd:string ] .
<http://s/j/1> a aida:TextJustification ; aida:startOffset "11"^^xsd:int ; aida:endOffsetInclusive "14"^^xsd:int ; aida:source "D1"^^xsd:string .
<http://s/clusters/own/entity/D1/EN_Entity_EDL_ENG_0000002> a aida:SameAsCluster ;
    aida:prototype <http://s/entities/own/D1/EN_Entity_EDL_ENG_0000002> .
<http://s/entities/own/D1/EN_Entity_EDL_ENG_0000002> a aida:Entity ;
    aida:justifiedBy <http://s/j/2> ;
    aida:link [ a aida:LinkAssertion ; aida:linkTarget "Q2"^^xsd:string ] .
<http://s/j/2> a aida:TextJustification ; aida:startOffset "40"^^xsd:int ; aida:endOffsetInclusive "44"^^xsd:int ; aida:source "D1"^^xsd:string .
<http://s/arg/1> a rdf:Statement,
        aida:ArgumentStatement ;
    rdf:object <http://s/entities/own/D1/EN_Entity_EDL_ENG_0000001> ;
    rdf:predicate "A0"^^xsd:string ;
    rdf:subject <http://s/events/own/D1/EN_Event_000000> .
<http://s/type/1> a rdf:Statement, aida:TypeStatement ; rdf:object "Q5"^^xsd:string ; rdf:predicate rdf:type ; rdf:subject <http://s/entities/own/D1/EN_Entity_EDL_ENG_0000001> .
"""
OTHER = HEAD + """<http://o/claims#77> a aida:Claim ;
    aida:claimSemantics <http://o/cluster/1> ; aida:associatedKEs <http://o/cluster/1> ;
    aida:justifiedBy <http://o/j/claim> .
<http://o/j/claim> a aida:TextJustification ; aida:source "D1" ; aida:sourceDocument "DOC-1" ; aida:confidence [ a aida:Confidence ; aida:confidenceValue 5.0E-01 ] .
<http://o/events/5> a aida:Event ; aida:justifiedBy <http://o/j/5> .
<http://o/j/5> a aida:TextJustification ; aida:startOffset "2"^^xsd:int ; aida:endOffsetInclusive "8"^^xsd:int ; aida:source "D1" .
<http://o/entities/6> a aida:Entity ; aida:justifiedBy <http://o/j/6> .
<http://o/j/6> a aida:TextJustification ; aida:startOffset "11"^^xsd:int ; aida:endOffsetInclusive "14"^^xsd:int ; aida:source "D1" .
"""


def test_merge_of_folders(spark, tmp_path):
    """Files as other tools write them: prefixes, nested blank nodes, several types and objects."""
    for name, text in (("a", OWN), ("b", OTHER)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}1.ttl").write_text(text)
    (tmp_path / "b" / "nothing.ttl").write_text(HEAD + "<http://o/x> a aida:Entity .\n")
    cli.main(["merge", "--first", str(tmp_path / "a"), "--second", str(tmp_path / "b"), "--out", str(tmp_path / "m")], spark)
    got = turtle.read_turtle(spark, str(tmp_path / "m")).collect()
    assert {r.graph_id for r in got} == {"DOC-1"}
    has = lambda s, p: {r.o for r in got if r.s == s and r.p == (V.TYPE if p == "a" else V.iri(p))}
    c = "http://s/clusters/own/"
    clusters = {f"{c}events/D1/EN_Event_000000", f"{c}entity/D1/EN_Entity_EDL_ENG_0000001", f"{c}entity/D1/EN_Entity_EDL_ENG_0000002", "http://o/cluster/1"}
    assert has("http://o/claims#77", "aida:claimSemantics") == has("http://o/claims#77", "aida:associatedKEs") == clusters
    # found at the first probe and at the same place; the third has no partner and comes whole
    assert has(f"{c}events/D1/EN_Event_000000", "aida:prototype") == {"http://o/events/5"} and has(f"{c}entity/D1/EN_Entity_EDL_ENG_0000001", "aida:prototype") == {"http://o/entities/6"}
    third = "http://s/entities/own/D1/EN_Entity_EDL_ENG_0000002"
    assert has(f"{c}entity/D1/EN_Entity_EDL_ENG_0000002", "aida:prototype") == {third} and has("http://s/j/2", "aida:sourceDocument") == {"DOC-1"} and has("http://s/j/2", "aida:startOffset") == {"40"}
    (link,) = has(third, "aida:link")
    assert link.startswith("_:") and has(link, "aida:linkTarget") == {"Q2"} and not has("http://s/j/1", "a") and not has("http://s/entities/own/D1/EN_Entity_EDL_ENG_0000001", "a")
    assert has("http://s/arg/1", "rdf:subject") == {"http://o/events/5"} and has("http://s/arg/1", "rdf:object") == {"http://o/entities/6"} and not has("http://s/type/1", "a")
    assert {r.o_type for r in got if r.s == "http://s/j/2" and r.p.endswith("#startOffset")} == {V.XSD + "int"}


def test_claims_to_turtle_and_merge(spark, tmp_path):
    """What claim_triples writes is read back as it was, and merges with another store."""
    t = aif.claim_triples(*graphs._claim_tables(spark), V.System("http://s", "x"))
    turtle.write_turtle(t, str(tmp_path / "t"))
    back = turtle.read_turtle(spark, str(tmp_path / "t"))
    assert sorted(map(str, back.select(t.columns).collect())) == sorted(map(str, t.collect()))
    blanks = {r.s for r in t.collect() if r.s.startswith("_:")}
    assert blanks == {r.o for r in t.collect() if r.o_kind == "bnode"}


def graph_files(spark, folder, graphs):
    """Writes graphs (name, tokens, [(node, label, token index or None)], [(parent, role, child)], root) as tables."""
    t = {n: [] for n in workflow.GRAPH_TABLES}
    for g, words, nodes, edges, root in graphs:
        t["graphs"].append((g, root, " ".join(words)))
        t["tokens"] += [(g, i, w) for i, w in enumerate(words)]
        t["nodes"] += [(g, n, i, label) for i, (n, label, _) in enumerate(nodes)]
        t["edges"] += [(g, i, p, r, c) for i, (p, r, c) in enumerate(edges)]
        t["alignments"] += [(g, i, n, k) for i, (n, _, k) in enumerate(nodes) if k is not None]
    kinds = {"graphs": "graph_id string, root string, token_text string", "tokens": "graph_id string, idx int, token string", "nodes": "graph_id string, node_id string, ord int, label string", "edges": "graph_id string, ord int, parent string, role string, child string", "alignments": "graph_id string, ord int, node_id string, token_idx int"}
    for n, rows in t.items():
        spark.createDataFrame(rows, kinds[n]).write.parquet(f"{folder}/{n}")


def test_texts_to_turtle(spark, tmp_path):
    """The whole run: detected claims, their graphs by a parser, entities, JSON, Turtle."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "D1.txt").write_text("Nothing here. Doctors said garlic prevents flu. Garlic prevents flu?\n")
    (tmp_path / "p.json").write_text('{"X prevents flu": [[{"LOWER": "garlic"}, {"LEMMA": "prevents"}, {"TEXT": "flu"}]]}')
    (tmp_path / "t.tsv").write_text("ID\tsubtopic\ttopic\tTemplate\nC1\tprevention\thealth\tX prevents flu\n")
    claim = (["prevent", "garlic", "flu"], [("v", "prevent-01", 1), ("g", "garlic", 0), ("f", "flu", 2)], [("v", ":ARG0", "g"), ("v", ":ARG1", "f")])
    whole = ("s1", "Doctors said garlic prevents flu .".split(), [("s", "say-01", 1), ("d", "doctor", 0), ("v", "prevent-01", 3), ("g", "garlic", 2), ("f", "flu", 4)], [("s", ":ARG0", "d"), ("s", ":ARG1", "v"), ("v", ":ARG0", "g"), ("v", ":ARG1", "f")], "s")
    graph_files(spark, tmp_path / "g" / "sentences", [whole])
    graph_files(spark, tmp_path / "g" / "texts", [("c1", "garlic prevents flu".split(), *claim[1:], "v")])
    save = lambda rows, kind, name: spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name))
    claims = workflow.detect(spark, str(tmp_path / "in"), str(tmp_path / "p.json"), str(tmp_path / "t.tsv")).collect()
    (first, second) = sorted(claims, key=lambda r: r.span_start)
    assert workflow.parser_input(spark.createDataFrame(claims, "claim_id string, doc_id string, sent_id int, claim_text string, claim_sentence string, sent_start int, span_start int, span_stop int, template string, topic string, subtopic string")).count() == 4
    save([(first.claim_id, i, w) for i, w in enumerate(["garlic", "prevent", "flu"])], "claim_id string, i int, lemma string", "g/words")
    save([(first.claim_id, "said", "VERB")], "claim_id string, token string, pos string", "g/pos")
    save([("say",)], "verb string", "tables/verbs")
    save([("prevent-01", "Q10", "prevention", 0.5)], "pb string, qnode string, name string, score double", "tables/chosen")
    save([("Q10", "A0", "who"), ("Q10", "A1", "what")], "qnode string, role string, text_role string", "tables/roles")
    save([("garlic", "Q20", "garlic plant"), ("flu", "Q30", "influenza"), ("doctors", "Q40", "physician")], "query string, qnode string, name string", "tables/names")
    (tmp_path / "e.cs").write_text(":E1\ttype\thttps://o#PER.Doctor\n:E1\tlink\tQ99\n:E1\tmention\t\"Doctors\"\tD1:14-20\t1.0\n:E2\ttype\thttps://o#MHI.Flu\n:E2\ttypelink\tQ77\n:E2\tmention\t\"flu\"\tD1:43-45\t1.0\n")
    save([("Q99", "the doctors"), ("Q77", "disease")], "qnode string, name string", "known")
    # a role labeller's words for both claims; the first claim has a variable by its graph already
    for n, word in (("templates", "this"), ("claims", "Leeks")):
        save([(c, "ARG0", 0, word) for c in (first.claim_id, second.claim_id)] + [(second.claim_id, "ARG1", 1, "flu")], "claim_id string, tag string, i int, word string", f"srl/{n}")
    cli.main(["run", *[x for o, v in {"input": "in", "patterns": "p.json", "topics": "t.tsv", "graphs": "g", "tables": "tables", "entities": "e.cs", "known": "known", "out": "out", "role-words": "srl"}.items() for x in (f"--{o}", str(tmp_path / v))], "--domain", "health"], spark)
    by_id = {r.claim_id: r for r in corpus.read_annotated(spark, str(tmp_path / "out" / "json")).collect()}
    c, other = by_id[first.claim_id], by_id[second.claim_id]
    assert (c.x_text, c.x_type.qnode_id, c.x_identity, c.claimer_text, c.topic) == ("garlic", "Q20", None, "Doctors", "health")
    # the claimer is an entity: its link is the identity, its kind the type; its place is that in the document
    assert (c.claimer_identity.qnode_id, c.claimer_identity.text, c.claimer_type.qnode_id, c.claimer_identity.start, c.claimer_start) == ("Q99", "the doctors", "Q5", 14, 14)
    (event,) = c.claim_semantics
    assert (event.qnode_id, event.text, event.confidence) == ("Q10", "prevention", 0.5) and {a.role: (a.type.qnode_id, a.identity and a.identity.qnode_id) for a in event.args} == {"A0": ("Q20", None), "A1": ("Q77", "Q30")}
    assert other.x_text == "Leeks" and other.x_type is None and other.claim_semantics is None
    t = turtle.read_turtle(spark, str(tmp_path / "out" / "turtle")).collect()
    has = lambda p: {r.o for r in t if r.p == V.iri(p)}
    assert {r.graph_id for r in t} == {"D1"} and has("aida:claimId") == {first.claim_id} and has("aida:linkTarget") >= {"Q99", "Q30"} and has("aida:componentIdentity") >= {"Q99"}
    assert len(has("aida:claimSemantics")) == 3 and {"Q10", "Q20", "Q77"} <= has("rdf:object")
    cli.main(["frames", "--input", str(tmp_path / "out" / "linked"), "--out", str(tmp_path / "f")], spark)
    assert spark.read.csv(str(tmp_path / "f"), header=True).first()["x_share"] == "1.0"
    cli.main(["topics-by-similarity", "--input", str(tmp_path / "out" / "claims"), "--topics", str(tmp_path / "t.tsv"), "--out", str(tmp_path / "s")], spark)
    assert {r.topic for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"health"}
