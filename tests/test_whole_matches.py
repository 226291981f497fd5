"""Matches of any length: the corpus queries against a search of every span."""

import re

from pyspark.sql import functions as F

from claimloom.operators import matching as M
from claimloom.plans import corpus as C


def _letters(tokens) -> str:
    """One class letter for a token, as the SQL has them."""

    def letter(t) -> str:
        if t.lemma in ("de", "von", "of"):
            return "o" if t.text == t.lemma else "p"
        if t.lemma == "in":
            return "i"
        if t.pos == "DET":
            return "e" if t.text in ("the", "an") else "d"
        return {"ADP": "p", "VERB": "b"}.get(t.pos, "T" if t.text == "that" else "n")

    return "".join(map(letter, tokens))


def test_matches_of_any_length(spark, sf):
    got = {(r.doc_id, r.sent_id, r.template, r.first_token, r.last_token) for r in C.claim_matches(spark, sf).collect()}
    shapes = {"X of Y": "[nTde]o[de]?[nT]", "X is Y": "[de][nT]+b[oip]?[nT]", "Y in X": "[nT]i[oip]*[eT]"}
    want = set()
    for r in M.tokenised(C._docs(spark, sf).select("doc_id", "text"), C.tagger).collect():
        c = _letters(r.tokens)
        for name, shape in shapes.items():
            for m in re.finditer(f"(?=({shape}))", c):  # each start; then every end from it
                for b in range(m.start() + 1, m.end(1) + 1):
                    if re.fullmatch(shape, c[m.start() : b]):
                        want.add((r.doc_id, r.sent_id, name, m.start(), b))
    assert got == want
    assert max(b - a for *_, a, b in got) > 8  # what a bound used to cut


def test_counts_hold_the_long_matches(spark, sf):
    n = C.claim_matches(spark, sf).count()
    for query in (C.claim_topics, C.flagship_topic_counts):
        assert query(spark, sf).agg(F.sum("n_claims")).first()[0] == n


def test_every_end_of_a_start(spark):
    p = M.load_patterns('{"t": [[{"POS": "N", "OP": "+"}, {"LEMMA": "be", "OP": "?"}, {"POS": "N", "OP": "*"}]]}')
    for line in ("N N be N N", "be", "be N be be N", "x N x", "N " * 12):
        words = line.split()
        toks = ", ".join(f"named_struct('text', '{w}', 'lemma', '{w}', 'pos', '{w}', 'ent_type', '')" for w in words)
        got = sorted((r.first, r.last) for r in M.matches(spark.sql(f"SELECT array({toks}) AS tokens"), p).collect())
        c = "".join(w[0] for w in words)
        assert got == [(a, b) for a in range(len(c)) for b in range(a + 1, len(c) + 1) if re.fullmatch("N+b?N*", c[a:b])]
