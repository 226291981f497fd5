"""Operators on rows worked out by hand, and against brute force."""

import itertools
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import aif, amr, candidates, claims, graph, matching, qnodes, spans
from claimloom.session import dense_ids


def brute_matches(masks, steps):
    """All (first, last) that a sequence of (predicate bit, quantifier) accepts."""
    out = set()
    n = len(masks)

    def run(i, k, start):
        if k == len(steps):
            if i > start:
                out.add((start, i))
            return
        bit, op = steps[k]
        ok = lambda j: j < n and masks[j] & bit
        if op in ("?", "*"):
            run(i, k + 1, start)
        if op in ("", "?"):
            if ok(i):
                run(i + 1, k + 1, start)
        else:
            j = i
            while ok(j):
                j += 1
                run(j, k + 1, start)

    for s in range(n):
        run(s, 0, s)
    return out


@pytest.mark.parametrize("steps", [[(1, "+"), (2, "")], [(1, ""), (3, "*"), (2, "?"), (4, "+")], [(4, "?"), (1, "+"), (2, "+"), (1, "")]])
def test_matcher_finds_all_overlapping_matches(spark, steps):
    g = np.random.default_rng(len(steps))
    names = {1: {"LEMMA": "a"}, 2: {"POS": "B"}, 4: {"ENT_TYPE": {"IN": ["C", "D"]}}, 3: {"LEMMA": "a", "POS": "B"}}
    pattern = matching.compile_pattern("t", 0, [names[b] | ({"OP": op} if op else {}) for b, op in steps], [])
    units, want = [], {}
    for u in range(60):
        masks = [int(x) for x in g.integers(0, 8, g.integers(0, 9))]
        units.append((u, [(i, "w", "a" if m & 1 else "z", "B" if m & 2 else "Y", ["C", "D"][i % 2] if m & 4 else None) for i, m in enumerate(masks)]))
        bits = [(b, op) for b, op in steps]
        # a step with two predicates needs both
        table = [[bool(m & b) if b != 3 else m & 3 == 3 for b, _ in bits] for m in masks]
        coded = [sum(1 << k for k in range(len(bits)) if row[k]) for row in table]
        want[u] = brute_matches(coded, [(1 << k, op) for k, (_, op) in enumerate(bits)])
    df = spark.createDataFrame(units, "u int, tokens array<struct<i:int,text:string,lemma:string,pos:string,ent_type:string>>")
    got = {}
    for r in matching.matches(df, [pattern]).collect():
        assert (r["first"], r["last"]) not in got.setdefault(r.u, set())
        got[r.u].add((r["first"], r["last"]))
    assert got == {u: w for u, w in want.items() if w}


def test_patterns_from_json():
    p = matching.load_patterns(json.dumps({"X is it": [[{"TEXT": {"IN": "CORONA_NAME_VARIATIONS"}, "OP": "+"}, {"lemma": "be"}]]}))[0]
    assert p.predicates[0] == ("text", tuple(matching.NAME_VARIATIONS)) and (p.least, p.most) == (2, None)
    with pytest.raises(ValueError):
        matching.compile_pattern("t", 0, [{"TEXT": "a", "OP": "!"}], [])


def test_text_functions(spark):
    f = lambda e: spark.range(1).select(e.alias("x")).first().x
    lit = F.lit
    assert f(T.refine_tokens(F.array(lit('say("a")'), lit("b")), 50)) == ["say", "(", "'", "a", "'", ")", "b"]
    assert f(T.clip(F.array(*map(lit, ["the", "Old", "of", "man", "."])))) == ["Old", "of", "man"] and f(T.clip(F.array(lit("the"), lit(",")))) == []
    assert f(T.clip(F.array(lit("he"), lit("said")))) == ["he", "said"]
    assert [f(T.framenet_role(lit(r))) for r in (":ARG1-of", ":location", ":mod")] == ["A1", "loc", "mod"]
    assert f(T.stem_of_file(lit("/a/bird.rsd.txt"))) == "bird" and f(T.stem_of_file(lit("words.txt"))) == "words"
    assert f(T.source_of(lit("a.b.xml"))) == "a.b" and f(T.last_segment(lit("u#x/y"))) == "y" and f(T.source_of(lit(".rsd"))) == ".rsd"
    assert re.fullmatch(r"NIL\d{7}", f(T.nil_id(lit("x")))) and f(T.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) is None


def test_offsets(spark):
    d = spark.createDataFrame([("the cat the hat", ["the", "cat", "the", "hat", "zzz"])], "t string, w array<string>")
    r = d.select(matching.search_offsets(F.col("t"), F.col("w")).alias("o")).first().o
    assert [(x.token, x.start, x.stop) for x in r] == [("the", 0, 2), ("cat", 4, 6), ("the", 8, 10), ("hat", 12, 14), ("zzz", -1, 1)]
    s = spark.range(1).select(matching.span_of_text(F.array(F.lit(0), F.lit(8)), F.array(F.lit(6), F.lit(14))).alias("s"), matching.span_of_text(F.array(F.lit(9)), F.array(F.lit(3))).alias("n")).first()
    assert (s.s.start, s.s.stop) == (8, 14) and s.n is None


def test_span_joins_brute(spark):
    g = np.random.default_rng(1)
    m = [(i, int(g.integers(3)), int(a), int(a + g.integers(0, 900))) for i, a in enumerate(g.integers(0, 2000, 150))]
    s = [(i, int(g.integers(3)), int(a), int(a + g.integers(0, 30))) for i, a in enumerate(g.integers(0, 2000, 150))] + [(500 + i, *m[i][1:]) for i in range(0, 20, 3)]
    md, sd = spark.createDataFrame(m, "m_id long, doc long, m_start int, m_stop int"), spark.createDataFrame(s, "s_id long, doc long, s_start int, s_stop int")
    want = {}
    for i, d, a, b in m:
        exact = [k for k, e, x, y in s if (d, a, b) == (e, x, y)]
        inside = [k for k, e, x, y in s if d == e and a <= x and y <= b]
        want[i] = (min(exact), "exact") if exact else (min(inside), "contained") if inside else (None, None)
    assert {r.m_id: (r.s_id, r.how) for r in spans.linked_spans(md, sd).collect()} == want
    assert {r.m_id for r in spans.linked_spans(md, sd, contained=False).where("s_id is not null").collect()} == {i for i, v in want.items() if v[1] == "exact"}


def test_contained_texts_with_short_needles(spark):
    t = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a bcd"), (3, None), (4, "")], "doc_id int, text string")
    n = spark.createDataFrame([(1, "cat sat on"), (2, "he"), (3, "bcd"), (4, ""), (5, None), (6, "x y z")], "item_id int, needle string")
    for most in (spans.NEEDLE_BYTES, 140):
        assert sorted(map(tuple, spans.contained_texts(t, n, "doc_id", "item_id", most).collect())) == [(1, 1), (1, 2), (2, 3)]


def test_dense_ids(spark):
    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.n == r.k + 1 for r in dense_ids(d, "n", "k").collect())
    assert all(r.n == 2 * r.k for r in dense_ids(d, "n", "k", first=0, step=F.lit(2)).collect()) and dense_ids(d.limit(0), "n", "k").count() == 0


def test_most_general_stops_on_cycles(spark):
    c = spark.createDataFrame([("p-01", i, f"Q{i}", f"n{i}") for i in range(6)] + [("c-01", 0, "A", "a"), ("c-01", 1, "B", "b")], "pb string, ord int, qnode string, name string")
    p = spark.createDataFrame([(f"Q{i}", f"Q{i - 1}") for i in range(1, 6)] + [("A", "B"), ("B", "A")], "qnode string, parent string")
    assert [tuple(r) for r in qnodes.most_general(c, p).collect()] == [("p-01", "Q0")]


def test_confidence_text(spark):
    d = spark.createDataFrame([(0.5,), (None,), (0.0,), (0.999,), (12.0,), (0.0123,)], "c double")
    assert [r.x for r in d.select(aif.confidence(F.col("c")).alias("x")).collect()] == ["5.00E-01", "1.00E+00", "1.00E+00", "9.99E-01", "1.20E+01", "1.23E-02"]


def test_participles(spark):
    d = spark.createDataFrame([("cure",), ("lie",), ("run",), ("spread",), ("see",), ("argue",)], "v string")
    assert [r.x for r in d.select(candidates.participle(F.col("v")).alias("x")).collect()] == ["curing", "lying", "running", "spreading", "seeing", "arguing"]


def test_reachable_ends_on_cycles(spark):
    t = spark.createDataFrame([("g", str(i), "p", str((i + 1) % 7)) for i in range(7)] + [("g", "3", "p", "leaf")], "graph_id string, s string, p string, o string")
    got = graph.reachable(t, spark.createDataFrame([("g", "0")], "graph_id string, start string"))
    assert sorted(r.s for r in got.collect()) == [str(i) for i in range(7)]


def test_merge_twice_is_merge_once(spark):
    from claimloom.plans.graphs import FIRST, SECOND

    once = graph.merge_stores(FIRST.df(spark), SECOND.df(spark))
    assert sorted(map(tuple, graph.merge_stores(FIRST.df(spark), once).collect())) == sorted(map(tuple, once.collect()))


def test_nearest_template_ties_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    t = spark.createDataFrame([(7, [2.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0])], "template_id int, t array<double>")
    out = {r.id: (r.template_id, r.score) for r in claims.nearest_template(v, t).collect()}
    assert out[1] == (3, 1.0) and out[2][1] is None


def test_variable_rules_fall_through(spark):
    """A rule whose template fits but that finds no edge leaves the claim to later rules."""
    n = spark.createDataFrame([("g", "r", 0, "cure-01"), ("g", "x", 1, "thing")], "graph_id string, node_id string, ord int, label string")
    e = spark.createDataFrame([("g", 0, "r", ":ARG1", "x")], "graph_id string, ord int, parent string, role string, child string")
    t = spark.createDataFrame([("g", 0, "cures"), ("g", 1, "things")], "graph_id string, idx int, token string")
    a = spark.createDataFrame([("g", 0, "r", 0), ("g", 1, "x", 1)], "graph_id string, ord int, node_id string, token_idx int")
    c = spark.createDataFrame([("g", "person-X helped X")], "graph_id string, template string")
    out = amr.open_variables(c, spark.createDataFrame([("g", "r")], "graph_id string, root string"), n, e, t, amr.node_strings(t, a)).collect()
    assert [(r.prio, r.x_text) for r in out] == [(12, "things")]


def test_permuted_input_gives_the_same_rows(spark):
    from claimloom.plans.linking import CANDIDATES

    rows = CANDIDATES.rows
    want = None
    for order in itertools.islice(itertools.permutations(range(3)), 3):
        mixed = [rows[i] for k in order for i in range(k, len(rows), 3)]
        df = spark.createDataFrame(mixed, CANDIDATES.df(spark).schema)
        got = sorted((r.query, r.qnode, r["rank"]) for r in candidates.top_k(candidates.deduplicated(candidates.filtered(df))).collect())
        want = want or got
        assert got == want


def test_graphs_by_tokens(spark):
    c = spark.createDataFrame([(1, "a b"), (2, "c")], "claim_id int, words string")
    g = spark.createDataFrame([("g1", "a b"), ("g2", "x")], "graph_id string, token_text string")
    assert sorted(map(tuple, amr.graphs_by_tokens(c, g, "words").collect())) == [(1, "a b", "g1"), (2, "c", None)]


def test_closures_have_no_depth(spark):
    """A chain of 200 links, an ancestor 20 steps up, a description through 12 rolesets, a set of 40 candidates in a row."""
    t = spark.createDataFrame([("g", f"n{i}", "p", f"n{i + 1}") for i in range(200)] + [("g", "n200", "p", "end")], "graph_id string, s string, p string, o string")
    assert graph.reachable(t, spark.createDataFrame([("g", "n0")], "graph_id string, start string")).count() == 201
    e = spark.createDataFrame([("g", i, f"n{i + 1}", ":ARG1", f"n{i}") for i in range(30)], "graph_id string, ord int, parent string, role string, child string")
    above = amr.first_above(e, spark.createDataFrame([("g", "n20"), ("g", "n25")], "graph_id string, node_id string"), spark.createDataFrame([("g", "n0")], "graph_id string, start string"))
    assert [(r.node_id, r.steps) for r in above.collect()] == [("n20", 20)]
    n = spark.createDataFrame([("g", f"n{i}", i, "do-01" if i else "thing") for i in range(13)], "graph_id string, node_id string, ord int, label string")
    words = spark.createDataFrame([("g", i, f"w{i}") for i in range(13)], "graph_id string, idx int, token string")
    at = spark.createDataFrame([("g", i, f"n{i}", i) for i in range(13)], "graph_id string, ord int, node_id string, token_idx int")
    d = amr.descriptions(n, e.where("ord < 12"), words, amr.node_strings(words, at))
    assert d.where("node_id = 'n12'").first().description == " ".join(f"w{i}" for i in range(13))
    c = spark.createDataFrame([("p-01", i, f"Q{i:02d}", f"n{i}") for i in range(40)], "pb string, ord int, qnode string, name string")
    p = spark.createDataFrame([(f"Q{i:02d}", f"Q{i - 1:02d}") for i in range(1, 40)], "qnode string, parent string")
    assert [tuple(r) for r in qnodes.most_general(c, p).collect()] == [("p-01", "Q00")]


def test_first_above_goes_depth_first(spark):
    """The parent by the first edge is followed to its end before the next one, and no walk goes on from a wanted node."""
    edges = [("a", 0, "b"), ("b", 5, "c"), ("c", 7, "x"), ("a", 1, "y"), ("y", 2, "z"), ("c", 8, "a")]
    e = spark.createDataFrame([("g", o, p, ":r", c) for c, o, p in edges], "graph_id string, ord int, parent string, role string, child string")
    above = lambda *w: [(r.node_id, r.steps) for r in amr.first_above(e, spark.createDataFrame([("g", x) for x in w], "graph_id string, node_id string"), spark.createDataFrame([("g", "a")], "graph_id string, start string")).collect()]
    assert above("x", "y", "z") == [("x", 3)] and above("y", "z") == [("y", 4)] and above("z") == [("z", 5)] and above("none") == []  # by way of b, c and a


def test_many_templates(spark):
    g = np.random.default_rng(0)
    v = spark.createDataFrame([(i, g.normal(size=4).tolist()) for i in range(40)], "id int, v array<double>")
    t = spark.createDataFrame([(i, g.normal(size=4).tolist()) for i in range(30)], "template_id int, t array<double>")
    assert sorted(map(tuple, claims.nearest_template(v, t, block=7).collect())) == sorted(map(tuple, claims.nearest_template(v, t).collect()))


def test_near_spans_by_brute_force(spark):
    g = np.random.default_rng(2)
    m = [(i, "d", int(a), int(a) + int(b)) for i, (a, b) in enumerate(zip(g.integers(0, 40, 60), g.integers(0, 4, 60)))]
    s = [(i, "d", int(a), int(a) + int(b)) for i, (a, b) in enumerate(zip(g.integers(0, 40, 40), g.integers(-1, 5, 40)))]
    want = {}
    for i, _, a, b in m:
        tries = [(a - 1, b - 1), (a - 1, b), (a - 1, b + 1), (a, a - 1), (a, b), (a, b + 1), (a + 1, b - 1), (a + 1, b), (a + 1, b + 1)]
        for k, t in enumerate(tries):
            hits = [j for j, _, x, y in s if (x, y) == t]
            if hits:
                want[i] = (max(hits), k)
                break
    out = spans.near_spans(spark.createDataFrame(m, "m_id int, doc string, m_start int, m_stop int"), spark.createDataFrame(s, "s_id int, doc string, s_start int, s_stop int"))
    assert {r.m_id: (r.s_id, r.probe) for r in out.collect()} == want


def test_matcher_is_linear(spark):
    """A sentence of 64,000 words takes no square of its length."""
    import time

    p = matching.load_patterns(json.dumps({"a": [[{"POS": "N", "OP": "+"}, {"TEXT": "v"}]], "b": [[{"TEXT": "d"}, {"POS": "N", "OP": "+"}, {"TEXT": "v"}]]}))
    words = ["d"] + ["n"] * 64_000
    df = spark.createDataFrame([(1, [(i, w, w, "N" if w == "n" else "V", "") for i, w in enumerate(words)])], "u int, tokens array<struct<i:int,text:string,lemma:string,pos:string,ent_type:string>>")
    began = time.time()
    assert matching.matches(df, p, keep=["u"]).count() == 0
    d = spark.createDataFrame([(" ".join(words), words)], "t string, w array<string>")
    assert d.select(F.size(matching.search_offsets(F.col("t"), F.col("w"))).alias("n")).first().n == 64_001
    assert time.time() - began < 30


def test_roles_are_those_of_the_events_own_graph(spark):
    """Two graphs with the same node ids; each event takes the roles of its own node only."""
    from claimloom.operators import semantics

    nodes = spark.createDataFrame([(g, n, i, label) for g, pb in (("g1", "go-01"), ("g2", "see-01")) for i, (n, label) in enumerate([("n0", pb), ("n1", "cat"), ("n2", "dog")])], "graph_id string, node_id string, ord int, label string")
    edges = spark.createDataFrame([(g, i, "n0", r, c) for g in ("g1", "g2") for i, (r, c) in enumerate([(":ARG0", "n1"), (":ARG1", "n2")])], "graph_id string, ord int, parent string, role string, child string")
    strings = spark.createDataFrame([("g1", "n0", "goes"), ("g2", "n0", "sees")], "graph_id string, node_id string, text string")
    chosen = spark.createDataFrame([("go-01", "Q1", 0.5), ("see-01", "Q2", 0.5)], "pb string, qnode string, score double")
    roles = spark.createDataFrame([("Q1", "A0"), ("Q2", "A1")], "qnode string, role string")
    args = semantics.claim_events(nodes, edges, strings, chosen, roles)[1]
    assert sorted(map(tuple, args.collect())) == [("g1", "n0", "A0", "cat"), ("g2", "n0", "A1", "dog")]


@pytest.mark.parametrize("within", [200_000, 0])
def test_closure_follows_what_starts_lead_to(spark, monkeypatch, within):
    """In one task and in rounds: chains, cycles, starts without a step, node names that repeat over graphs."""
    from claimloom.operators import graph

    monkeypatch.setattr(graph, "TASK_STEPS", within)
    g = np.random.default_rng(within)
    steps = [("c", f"n{i}", f"n{i + 1}") for i in range(8)] + [("o", "x", "y"), ("o", "y", "x"), ("o", "n0", "x")] + [("r", f"n{a}", f"n{b}") for a, b in g.integers(0, 12, (25, 2))]
    starts = [("c", "n0"), ("c", "n5"), ("o", "x"), ("o", "n0"), ("o", "gone"), ("r", "n1"), ("r", "n1"), ("none", "q")]
    want = set()
    for graph_id, start in starts:
        met, front = {start}, [start]
        while front:
            at = front.pop()
            for h, a, b in steps:
                if (h, a) == (graph_id, at) and b not in met:
                    met.add(b)
                    front.append(b)
        want |= {(graph_id, start, s) for s in met}
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(steps, "graph_id string, a string, b string"), spark.createDataFrame(starts, "graph_id string, start string")).collect()]
    assert sorted(got) == sorted(want)


def test_closure_of_a_large_graph_is_quick(spark):
    """A chain of 100,000 triples with one start."""
    import time

    from claimloom.operators import graph

    chain = spark.range(100_000).selectExpr("'g' graph_id", "concat('n', id) a", "concat('n', id + 1) b")
    began = time.time()
    assert graph.closure(chain, spark.createDataFrame([("g", "n60000")], "graph_id string, start string")).count() == 40_001
    assert time.time() - began < 40
