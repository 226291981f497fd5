"""Tokens without loss, sentence borders, the token store, and claims found in whole documents."""

import json
import math
import random
import re
from collections import Counter

import pytest

from claimloom import cli
from claimloom.functions import tokens as TK
from claimloom.operators import borders as B
from claimloom.operators import documents as D
from claimloom.operators import matching as M
from claimloom.plans import workflow
from claimloom.sources import tokens as store


@pytest.mark.parametrize(
    "text, want",
    [
        ("COVID-19", "COVID-19"), ("(COVID-19).", "( COVID-19 ) ."), ("U.S.", "U.S."), ("the U.S., too", "the U.S. , too"), ("3.5%", "3.5 %"), ("(x)", "( x )"), ('"Yes!"', '" Yes ! "'),
        ("well-known", "well - known"), ("don't it's we'll", "do n't it 's we 'll"), ("$5.20", "$ 5.20"), ("J. Smith left.", "J. Smith left ."), ("10km/h", "10km / h"), ("12kg.", "12 kg ."), ("wait...what?", "wait ... what ?"),
        ("SARS-CoV-2,", "SARS-CoV-2 ,"), ("bats, (Coronavirus)", "bats , ( Coronavirus )"), ("a@b.org;", "a@b.org ;"), ("see https://a.b/c?d=1.", "see https://a.b/c?d=1 ."), ("one,two", "one , two"), ("End.Next", "End . Next"), ("U.S.-led", "U.S. - led"),
        ("e.g., this", "e.g. , this"), ("-5 to +7", "-5 to +7"), ("", ""), ("...", "..."), ("((", "( ("), ("日本語。", "日本語 。"), ("l’été", "l’été"), ("5-10", "5-10"),
    ],
)
def test_cuts(text, want):
    tokens, starts, spaces = workflow.tokenizer()(text)
    assert " ".join(t for t in tokens if not t.isspace()) == want
    assert TK.rebuilt(tokens, spaces) == text and all(text[a : a + len(t)] == t for t, a in zip(tokens, starts, strict=True))


def test_exceptions_in_pieces():
    tool = TK.Tokenizer({"cannot": [3, 3], "U.S.": [4], "gimme": [3, 2]})
    assert tool("(cannot gimme, cannots)")[0] == ["(", "can", "not", "gim", "me", ",", "cannots", ")"]
    with pytest.raises(ValueError):
        TK.Tokenizer({"ab": [1]})


def test_trie_finds_the_longest():
    t = TK.Trie(["a.", "a.b.", "x"])
    assert [t.longest(s, 0, len(s)) for s in ("a.b.c", "a.b.", "a.c", "x1", "x-", "y", "")] == [0, 4, 0, 0, 1, 0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_any_text_is_rebuilt(seed):
    g = random.Random(seed)
    parts = ["a", "B", "é", "1", ".", ",", "-", "—", "'", "’s", "n't", "(", ")", " ", "  ", "\n", "\t", " ", "…", "%", "km", "$", "U.S.", "http://x.y", "日", "\x00", "\U0001f600", "..", "@", "_", "/"]
    tool = TK.Tokenizer(known=50)
    for _ in range(500):
        text = "".join(g.choice(parts) for _ in range(g.randrange(0, 25)))
        tokens, starts, spaces = tool(text)
        assert TK.rebuilt(tokens, spaces) == text and all(tokens) and all(text[a : a + len(t)] == t for t, a in zip(tokens, starts, strict=True))


def test_documents_are_rebuilt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n ")], docs.schema))
    out = TK.tokenised_documents(docs)
    rows = out.withColumn("again", D.text_of(out["tokens"])).collect()
    assert len(rows) == docs.count() and all(r.again == r.text for r in rows)
    for r in rows:
        sent = [t.sent for t in r.tokens or []]
        assert sent == sorted(sent) and (not sent or sent[0] == 0) and set(sent) == set(range(max(sent, default=-1) + 1))


def sentences(text, borders):
    tokens, _, spaces = TK.Tokenizer()(text)
    out: dict[int, str] = {}
    for t, s, n in zip(tokens, spaces, borders.numbers(tokens, spaces), strict=True):
        out[n] = out.get(n, "") + t + (" " if s else "")
    return [out[k].strip() for k in sorted(out)]


def test_borders():
    known = B.Borders(frozenset({"approx", "bzw"}), frozenset({"the"}), lines=False)
    assert sentences("The U.S. said 3.5 percent. It rose.", known) == ["The U.S. said 3.5 percent.", "It rose."]
    assert sentences("Mr. J. Smith left. He (too.) stayed! Why? ok", known) == ["Mr. J. Smith left.", "He (too.) stayed!", "Why?", "ok"]
    assert sentences("It is approx. Ten. It is approx. The end.", known) == ["It is approx. Ten.", "It is approx.", "The end."]
    assert sentences("He said “Stop.” Then he left… and came. No. 5 won", known)[:2] == ["He said “Stop.”", "Then he left… and came."]
    assert sentences("one\ntwo.\n\nthree", known) == ["one\ntwo.", "three"] and sentences("one\ntwo", B.Borders()) == ["one", "two"]
    assert sentences("am 3. 10. wir. a.b", known) == ["am 3. 10. wir. a.b"] and sentences("", known) == [] and sentences("\n \n", known) == [""]


def test_counts_and_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60)
    texts = [r.text for r in docs.collect()]
    n, k = Counter(), Counter()
    for text in texts:
        tokens, _, spaces = TK.Tokenizer()(text or "")
        for i, t in enumerate(tokens):
            if re.search(r"[^\W_]", t) and not re.fullmatch(r"[+-]?\d[\d.,]*", t):
                own = len(t) > 1 and t.endswith(".")
                w = t.lower().rstrip(".") if own else t.lower()
                n[w] += 1
                k[w] += own or (tokens[i + 1 : i + 2] == ["."] and not spaces[i])
    counts = B.word_counts(docs.repartition(3))
    assert {r.word: (r.n, r.n_stop) for r in counts.collect()} == {w: (n[w], k[w]) for w in n}
    p, want = sum(k.values()) / sum(n.values()), {}
    for w in n:
        if k[w]:
            like = lambda q, w=w: k[w] * math.log(q) + (n[w] - k[w]) * math.log(1 - q)
            size = len(w) - w.count(".")
            score = 2 * (like(0.99) - like(p)) * math.exp(-size) * (w.count(".") + 1) * size ** -(n[w] - k[w])
            if score >= 0.3:
                want[w] = score
    got = {r.word: r.score for r in B.abbreviations(counts).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)


def test_learning(spark):
    """An abbreviation and a starter that no list has."""
    g = random.Random(2)
    nouns = "leute ruhe haus wald boot berg fluss brot tisch stein feld licht wind meer dorf".split()

    def sentence():
        words = [g.choice(nouns).title() for _ in range(g.randrange(4, 9))]
        words.insert(g.randrange(1, 4), g.choice(["Hr. " + g.choice(["Meier", "Huber"]), f"ca. {g.randrange(99)}", "bzw. " + g.choice(nouns).title()]))
        return ("Dann " if g.random() < 0.5 else "") + " ".join(words) + "."

    rows = [(" ".join(sentence() for _ in range(12)),) for _ in range(150)]
    borders = B.learn_borders(spark.createDataFrame(rows, "text string").union(spark.createDataFrame([(None,), ("",)], "text string")), lines=False)
    assert borders.abbreviations == {"ca", "hr", "bzw"} and borders.starters == {"dann"}
    assert sentences("Es kam Hr. Huber. Dann ca. Hundert. Sie bzw. Dann er.", borders) == ["Es kam Hr. Huber.", "Dann ca. Hundert.", "Sie bzw.", "Dann er."]
    empty = B.learn_borders(spark.createDataFrame([], "text string"))
    assert not empty.abbreviations and not empty.starters


#: Patterns of the shape that a catalogue of a domain has, each asking for parts of speech, names and lemmas.
CATALOGUE = json.dumps({f"X {verb}s COVID-19": [[{"POS": {"IN": ["NOUN", "PROPN"]}, "OP": "+"}, {"LEMMA": verb, "OP": "+"}, {"TEXT": {"IN": "CORONA_NAME_VARIATIONS"}, "OP": "+"}]] for verb in "spread cure kill stop help harm end slow carry feed fear make take bring hide show".split()} | {f"COVID-19 is {a}": [[{"TEXT": {"IN": "CORONA_NAME_VARIATIONS"}}, {"LEMMA": "be"}, {"POS": "ADV", "OP": "*"}, {"LOWER": a}, {"ENT_TYPE": "GPE", "OP": "?"}]] for a in "bad good old new man-made gone here real fake over big small".split()})


def tag(tokens):
    """Tags as a tagger elsewhere would give them."""
    pos = {"Masks": "NOUN", "bats": "NOUN", "spread": "VERB", "is": "AUX", "very": "ADV", "Italy": "PROPN"}
    return [{**t.asDict(), "pos": pos.get(t.text, "X"), "lemma": {"is": "be"}.get(t.text, t.text.lower()), "ent_type": "GPE" if t.text == "Italy" else ""} for t in tokens]


def test_catalogue_over_a_token_store(spark, tmp_path):
    """Texts to a token table, tagged elsewhere, to claims: by Parquet, JSON lines and tab-separated text."""
    text = "Masks spread COVID-19. In bats spread SARS-CoV-2! SARS-CoV-2 is very bad Italy; bats, (Coronavirus) spread."
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(text)
    (tmp_path / "p.json").write_text(CATALOGUE)
    (tmp_path / "t.tsv").write_text("ID\tsubtopic\ttopic\tTemplate\nC1\tmasks\tspread\tX spreads COVID-19\n")
    path = lambda n: str(tmp_path / n)
    cli.main(["tokenise", "--input", path("in"), "--out", path("tokens"), "--learn-borders"], spark)
    (doc,) = store.read_tokens(spark, path("tokens")).collect()
    assert "".join(t.text + " " * t.space for t in doc.tokens) == text
    rows = [{"doc_id": doc.doc_id, "i": i, **t} for i, t in enumerate(tag(doc.tokens))]
    table = spark.createDataFrame(rows, store.TABLE)
    table.write.parquet(path("tagged"))
    table.write.json(path("json"))
    table.drop("start", "sent").write.options(header=True, sep="\t", quote="").csv(path("csv"))
    want = {("Masks spread COVID-19", "X spreads COVID-19"), ("bats spread SARS-CoV-2", "X spreads COVID-19"), ("SARS-CoV-2 is very bad", "COVID-19 is bad"), ("SARS-CoV-2 is very bad Italy", "COVID-19 is bad")}
    for kind, name in (("parquet", "tagged"), ("json", "json")):
        cli.main(["detect", "--tokens", path(name), "--token-format", kind, "--patterns", path("p.json"), "--topics", path("t.tsv"), "--out", path(f"claims-{kind}")], spark)
        got = spark.read.parquet(path(f"claims-{kind}")).collect()
        assert {(r.claim_text, r.template) for r in got} == want and len(got) == 4
        assert all(text[r.span_start : r.span_stop] == r.claim_text and text[r.sent_start :].startswith(r.claim_sentence) for r in got)
        assert {r.topic for r in got if r.template.startswith("X")} == {"spread"}
    # a table without places: its tokens and blanks make up the document
    rows = store.read_tokens(spark, path("csv"), "csv").collect()
    assert [t.start for t in rows[0].tokens] == [t.start for t in doc.tokens]
    with pytest.raises(ValueError):
        workflow.detect(spark, None, path("p.json"), path("t.tsv"))


def test_matches_are_those_of_the_units(spark, sf):
    """Over documents as over arrays of tokens, and over sentence borders."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    patterns = M.load_patterns(json.dumps({"p": [[{"LOWER": {"IN": ["the", "of", "de", "die"]}}, {"TEXT": {"IN": [".", ","]}, "OP": "*"}, {}, {"TEXT": {"IN": [".", ","]}, "OP": "?"}]]}))
    tagged = D.tagged(TK.tokenised_documents(docs))
    got = D.document_matches(tagged, patterns, keep=["doc_id", "text"]).collect()
    want = {(r.doc_id, r["first"], r["last"]) for r in M.matches(tagged, patterns, keep=["doc_id"]).collect()}
    assert {(r.doc_id, r["first"], r["last"]) for r in got} == want and len(got) == len(want) > 0
    assert all(r.text[r.span_start : r.span_stop].strip() == r.claim_text for r in got)
    assert all(r.text[r.sent_start : r.sent_start + len(r.claim_sentence)] == r.claim_sentence for r in got if not r.claim_sentence[:1].isspace())


def test_parser_tokens_have_marks_and_are_cut(spark):
    long = "He said: " + "a b, " * 30 + "end"
    df = spark.createDataFrame([('She (the "boss") left.',), (long,), (None,)], "t string")
    a, b, c = (r[0] for r in df.select(workflow.parser_tokens(df["t"], 50)).collect())
    assert a == ["She", "(", "the", "'", "boss", "'", ")", "left", "."] and b[-1] == "," and len(b) == 51 and not c


def test_matches_of_texts_are_those_of_tagged_tokens(spark, sf):
    from claimloom.operators import matching as M
    from claimloom.plans import language as L

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(150)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the İ, is and — ² and the Is from x.  on")], docs.schema))
    patterns = M.load_patterns(L.CATALOGUE)
    wanted = ["template", "first", "last", "span_start", "span_stop"]
    plain = D.document_matches(D.tagged(TK.tokenised_documents(docs), L._marked), patterns, keep=["doc_id"]).select("doc_id", *wanted)
    once = D.text_matches(docs, patterns, L.MARKED, wanted)
    assert once.columns == ["doc_id", *wanted] and once.count() > 100
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, plain.collect()))


def test_equal_runs_are_cut_once(spark):
    from claimloom.operators import borders as B

    class Seen(TK.Tokenizer):
        def __call__(self, text):
            assert not any(c.isspace() for c in text), "a text rather than a run"
            return super().__call__(text)

    texts = ["The U.S. and etc. x.\n\ta. (b.) 3. c.d. Etc. .", None, "", "   ", "etc.  . x .. x...", "a. b."] * 3
    want: Counter = Counter()
    for t in texts:
        if t:
            tokens, _, spaces = TK.Tokenizer()(t)
            want.update(B.words_and_stops(tokens, spaces))
    run = B.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"), TK.Tokenizer())
    assert {r.word: (r.n, r.n_stop) for r in run.collect()} == {w: (want[w, 0], want[w, 1]) for w, _ in want}
    B.word_counts(spark.createDataFrame([("a b. a b.",)], "text string"), Seen()).collect()
