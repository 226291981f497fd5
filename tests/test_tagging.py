"""Tags by a learned sequence model, and inflection by learned edits."""

import itertools
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimloom import cli
from claimloom.functions import tokens as TK
from claimloom.operators import documents as D
from claimloom.operators import inflection as I
from claimloom.operators import qnodes as Q
from claimloom.operators import tagging as G


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_exhaustive_search(seed):
    g = np.random.default_rng(seed)
    k = int(g.integers(1, 4))
    model = G.SequenceTagger([f"t{i}" for i in range(k)], {}, g.normal(size=(k + 1, k + 1, k)))
    for n in range(5):
        scores = g.normal(size=(n, k))

        def total(path, scores=scores, n=n):
            a = b = k
            out = 0.0
            for i, c in enumerate(path):
                out, a, b = out + scores[i, c] + model.chain[a, b, c], b, c
            return out

        assert model.decode(scores) == list(max(itertools.product(range(k), repeat=n), key=total))


def sentence(g):
    """A small language: "run" and "plan" are nouns after a determiner and verbs after a pronoun; -ly words are adverbs."""
    out = []
    for _ in range(g.randrange(1, 4)):
        if g.random() < 0.5:
            out += [(g.choice(["the", "a"]), "DET"), *([(g.choice(["big", "red"]), "ADJ")] if g.random() < 0.5 else []), (g.choice(["run", "plan", "cat"]), "NOUN")]
        else:
            out += [(g.choice(["they", "we"]), "PRON"), *([(g.choice("abcdefgh") + g.choice(["ardly", "uickly"]), "ADV")] if g.random() < 0.5 else []), (g.choice(["run", "plan", "see"]), "VERB")]
    return out


def table(spark, g, docs):
    rows = [(f"d{d}", i, w, s, t) for d in range(docs) for i, (w, s, t) in enumerate((w, s, t) for s in range(4) for w, t in [*sentence(g), (".", "PUNCT")])]
    return spark.createDataFrame(rows, "doc_id string, i int, text string, sent int, pos string")


def test_learned_tags(spark, tmp_path):
    g = random.Random(3)
    model = G.fit_tagger(table(spark, g, 60), shards=3)
    tests = [sentence(g) for _ in range(200)]
    right = Counter(t == p for s in tests for (_, t), p in zip(s, model([w for w, _ in s]), strict=True))
    assert right[True] / right.total() > 0.99 and model([]) == []
    path = str(tmp_path / "m")
    G.save_tagger(spark, model, path)
    again = G.load_tagger(spark, path)
    assert all(again([w for w, _ in s]) == model([w for w, _ in s]) for s in tests)
    docs = TK.tokenised_documents(spark.createDataFrame([(1, "The  big run.\nThey plan."), (2, None), (3, "")], "doc_id long, text string"))
    rows = {r.doc_id: r.tokens for r in G.tag_documents(D.tagged(docs), again).collect()}
    assert [(t.text, t.pos) for t in rows[1]] == [("The", "DET"), (" ", "SPACE"), ("big", "ADJ"), ("run", "NOUN"), (".", "PUNCT"), ("\n", "SPACE"), ("They", "PRON"), ("plan", "VERB"), (".", "PUNCT")]
    assert rows[2] is None and rows[3] == [] and [t.lemma for t in rows[1]][:3] == ["the", " ", "big"]


def test_a_mean_over_shards_is_that_of_one_pass(spark):
    """One shard and one epoch: the plain averaged perceptron, change by change."""
    g = random.Random(5)
    tokens = table(spark, g, 12)
    data = sorted(((r.key, list(r.words), list(r.tags)) for r in G.sentences_of(tokens).collect()))
    tags = sorted({t for _, _, s in data for t in s})
    model, total = G.SequenceTagger(tags), Counter()
    for _, words, gold in data:
        found = model(words)
        for path, by in ((gold, 1), (found, -1)) if found != gold else ():
            a = b = len(tags)
            for f, t in zip(model.features(words), path, strict=True):
                c = tags.index(t)
                for x in f:
                    model.weights.setdefault(x, np.zeros(len(tags)))[c] += by
                model.chain[a, b, c] += by
                a, b = b, c
        for f, t, w in model.rows():
            total[f, t] += w
    want = {k: w / len(data) for k, w in total.items() if w}
    # a sentence's change counts from the next sentence on
    late = G.SequenceTagger(tags).learn(iter([(w, t) for _, w, t in data]))[0]
    got = {(f, t): w for f, t, w in G.fit_tagger(tokens, shards=1, epochs=1).rows()}
    assert got.keys() == {(f, t) for f, t, _ in late.rows()} and all(abs(got[f, t] - w) < 1e-9 for f, t, w in late.rows())
    last = Counter({(f, t): w for f, t, w in model.rows()})
    # the mean of what the weights were before each sentence and after the last differ by the last change only
    for f, t, w in late.rows():
        assert abs(w - want.get((f, t), 0)) <= max(1.0, abs(last[f, t])) + 1e-9


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([("d", 0, "x", 0, None)], "doc_id string, i int, text string, sent int, pos string")
    model = G.fit_tagger(empty)
    docs = D.tagged(TK.tokenised_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string")))
    assert model.tags == [] and G.tag_documents(docs, model).collect() == docs.collect()


def test_detect_with_a_learned_tagger(spark, tmp_path):
    g = random.Random(8)
    table(spark, g, 60).write.parquet(str(tmp_path / "tagged"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("They run. The big run. We hardly plan a plan.")
    (tmp_path / "p.json").write_text(json.dumps({"X": [[{"POS": "PRON"}, {"POS": "ADV", "OP": "?"}, {"POS": "VERB"}]], "Y": [[{"POS": "DET"}, {"POS": "ADJ", "OP": "*"}, {"POS": "NOUN"}]]}))
    (tmp_path / "t.tsv").write_text("ID\tsubtopic\ttopic\tTemplate\n")
    cli.main(["fit-tagger", "--tokens", str(tmp_path / "tagged"), "--out", str(tmp_path / "model")], spark)
    cli.main(["detect", "--input", str(tmp_path / "in"), "--tagger", str(tmp_path / "model"), "--patterns", str(tmp_path / "p.json"), "--topics", str(tmp_path / "t.tsv"), "--out", str(tmp_path / "c")], spark)
    assert sorted((r.template, r.claim_text) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [("X", "They run"), ("X", "We hardly plan"), ("Y", "The big run"), ("Y", "a plan")]


def test_participles_both_ways(spark):
    tool = I.english_participles(spark)
    pairs = [p.split(" ") for p in I.ENGLISH_PARTICIPLES]
    assert all(tool.form("VBG", a) == b and tool.lemma("VBG", b) == a for a, b in pairs)
    for a, b in {"panic": "panicking", "begin": "beginning", "visit": "visiting", "lie": "lying"}.items():
        assert (tool.form("VBG", a), tool.lemma("VBG", b)) == (b, a)
    # verbs that no pair has
    new = {"frolic": "frolicking", "deposit": "depositing", "shop": "shopping", "spin": "spinning", "jump": "jumping", "bake": "baking", "remove": "removing", "permit": "permitting", "chat": "chatting"}
    assert sum(tool.form("VBG", a) == b for a, b in new.items()) >= 6
    assert tool.lemma("NNS", "cats") == "cats" and tool.lemma("VBG", "old") == "old" and tool.form("VBG", "") == "ing"
    df = spark.createDataFrame([("lie",), (None,), ("begin",)], "w string")
    assert [r[0] for r in df.select(tool.column("form", "VBG", df["w"])).collect()] == ["lying", None, "beginning"]


def test_edits_brute(spark):
    g = random.Random(4)
    stems = ["".join(g.choice("abe") for _ in range(g.randrange(1, 5))) for _ in range(60)]
    pairs = [(g.choice(["A", "B"]), s + g.choice(["s", "es", "ing", ""]), s, g.randrange(1, 4)) for s in stems] + [(None, "x", "y", 1), ("A", "", "b", 1), ("A", "b", None, 2)]
    seen: Counter = Counter()
    for kind, form, lemma, n in pairs:
        if form and lemma:
            for way, a, b in (("lemma", form, lemma), ("form", lemma, form)):
                k = 0
                while k < min(len(a), len(b)) and a[k] == b[k]:
                    k += 1
                marked = "^" + a
                for e in {marked[len(marked) - j :] if j else "" for j in range(min(3, len(marked)) + 1)}:
                    seen[way, kind or "", e, a[k:], b[k:]] += n
    df = spark.createDataFrame(pairs, "kind string, form string, lemma string, n long")
    assert {tuple(r)[:5]: r.n for r in I.edit_counts(df, 3).collect()} == dict(seen)
    want: dict = defaultdict(list)
    for (way, kind, e, fall, put), n in seen.items():
        want[way, kind, e].append((n, -len(fall), put, fall))
    assert {tuple(r)[:3]: (r.fall, r.put) for r in I.best_edits(I.edit_counts(df, 3)).collect()} == {k: max(v)[:1:-1] for k, v in want.items()}
    tool = I.learn_inflector(df, 3)
    total: dict = defaultdict(Counter)
    for kind, form, lemma, n in pairs:
        if form and lemma:
            total["lemma", kind or "", form][lemma] += n
            total["form", kind or "", lemma][form] += n
    for (way, kind, word), others in total.items():
        assert tool.turn(way, kind, word) == max(others, key=lambda o: (others[o], o))
    assert I.learn_inflector(df.where("false")).lemma("A", "abes") == "abes"


def test_mentions_are_asked_by_lemma(spark):
    tool = I.english_participles(spark)
    m = spark.createDataFrame([(1, "Old lying"), (2, "Running")], "m_id int, text string")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, Q.mention_queries(m, lambda c: tool.column("lemma", "VBG", F.lower(c))).collect()))
    assert got == [(1, 0, "old lie"), (1, 1, "Old lying"), (1, 2, "lie"), (1, 3, "lying"), (1, 4, "old"), (1, 5, "Old"), (2, 0, "run"), (2, 1, "Running")]
    assert sorted(map(tuple, Q.mention_queries(m).collect()))[0] == (1, 0, "old lying")


def test_many_sentences_are_decoded_as_each_is():
    import numpy as np
    import pyarrow as pa

    g = random.Random(3)
    made = [[g.choice(["Ab", "the", "x", "Éa", "1", "run", "."]) for _ in range(g.randrange(1, 9))] for _ in range(300)]
    model, _ = G.SequenceTagger(["A", "B", "C"]).learn((s, [g.choice("ABC") for _ in s]) for s in made)
    for m in (model, G.SequenceTagger(["A", "B"])):
        got = m.tags_of(pa.array([w for s in made for w in s]), np.array([len(s) for s in made]))
        assert [m.tags[k] for k in got] == [t for s in made for t in m(s)]


def test_a_fit_gathers_only_the_words_of_its_sentences(spark, monkeypatch):
    rows = [(d, s, i, w, "T") for d in range(40) for s in range(5) for i, w in enumerate("a b c".split())]
    taken, plain = [], G.sentences_of
    monkeypatch.setattr(G, "sentences_of", lambda t, c: taken.append(t.count()) or plain(t, c))
    G.fit_tagger(spark.createDataFrame(rows, "doc_id long, sent int, i int, text string, pos string"), sentences=20, shards=2, epochs=1)
    assert taken and taken[0] < 300


def test_numbered_tokens_are_the_tokenizers():
    import pyarrow as pa

    from claimloom.operators.borders import Borders, later_sentences

    g, tool, borders = random.Random(6), TK.Tokenizer({"Mr.": [3], "U.S.": [4], "cannot": [3, 3], "ab": [1, 1]}), Borders()
    bits = ["a", "B", "Mr.", "Mr", "U.S.", "cannot", "ab", " wordy", "don't", " ", "  ", "\n", "\t", "\x1c", "\u00a0", ".", "!", ",", ")", "#", "1", "é", "ß", "İ", "Σ"]
    for _ in range(150):
        texts = [None if g.random() < 0.05 else "".join(g.choices(bits, k=g.randrange(40))) for _ in range(g.randrange(9))]
        got, at = TK.Numbered.of(pa.array(texts, pa.string()), tool), 0
        assert got.words.to_pylist() == got.names
        for text, n, later in zip(texts, got.n.tolist(), later_sentences(got, borders), strict=True):
            words, _, spaces = tool(text or "")
            numbers = got.numbers[at : at + n]
            assert [got.names[k] for k in numbers] == words and got.spaces[at : at + n].tolist() == spaces
            assert got.blank[numbers].tolist() == [w.isspace() for w in words]
            sent = borders.numbers(words, spaces)
            assert later == [i for i in range(1, n) if sent[i] != sent[i - 1]]
            at += n


def test_scores_of_many_words_are_those_of_each():
    import pyarrow as pa

    g = np.random.default_rng(4)
    words = ["", "the", "The", "THE", "xXxX", "Straße", "ÀÉxe", "ÿ", "aB", "abcdefghijklMN", "ΣΑΣ", "İx", "ǅ", "a-b", "U.S.", "12x", "\u00d7", "ª"]
    model = G.SequenceTagger(["A", "B"], {f: g.normal(size=2) for w in words[::2] for f in (*G.word_features(w), f"-={w.lower()}", f"+={w.lower()}")})
    got = G.Decoder(model).scores(pa.array(words))
    for part, features in zip(got, (G.word_features, lambda w: (f"-={w.lower()}",), lambda w: (f"+={w.lower()}",)), strict=True):
        assert (part == model.scores([features(w) for w in words])).all()


def test_texts_are_fitted_and_counted_as_their_tokens(spark):
    """The plain way takes tokens as rows three times over; counts and model are the same, for equal ids and odd texts too."""
    from pyspark.sql import functions as F

    g = random.Random(12)
    rows = [(g.choice([None, *range(40)]), " ".join(w for _ in range(g.randrange(1, 6)) for w, _ in [*sentence(g), (".", "")])) for _ in range(60)]
    rows = [(d, t) for k, (d, t) in enumerate(rows) if d not in [x for x, _ in rows[:k]]] + [(90, None), (91, ""), (92, " \n "), (93, "\u00a0"), (94, "A  b. \n\n C\n \n d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tag = lambda w: F.when(w.isin("the", "a"), "DET").when(w.rlike("ly$"), "ADV").when(w == ".", "PUNCT").otherwise("NOUN")
    tokens = TK.tokenised_documents(docs).drop("text")
    for most in (30, 10_000):
        model = G.fit_on_texts(docs, tag, sentences=most, shards=2, epochs=2)
        plain = G.fit_tagger(D.token_table(tokens).withColumn("pos", tag(F.col("text"))), sentences=most, shards=2, epochs=2)
        own, other = ({(f, t): w for f, t, w in m.rows()} for m in (model, plain))
        assert own.keys() == other.keys() and all(abs(own[k] - other[k]) < 1e-9 for k in own)
        want = Counter((t.text, t.pos) for r in G.tag_documents(D.tagged(tokens), model).collect() for t in r.tokens or ())
        assert {(r.text, r.tag): r.n for r in G.tag_counts(docs, model).groupBy("text", "tag").agg(F.sum("n").alias("n")).collect()} == dict(want)
    empty = G.fit_on_texts(docs.where("doc_id = 92"), tag)
    assert empty.tags == [] and [tuple(r) for r in G.tag_counts(docs.where("doc_id = 92"), empty).collect()] == [(" \n ", None, 1)]
