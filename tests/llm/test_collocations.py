"""Collocations against a plain count, the perfect hash, and the limits that divide the work."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from claimloom.llm import collocations as co


def brute(rows, top=2000, least=10):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = defaultdict(list)
    for (lang, *p), a in found.items():
        if any(len(q) == 4 and len(p) == 2 and q[0] == lang and p in (list(q[1:3]), list(q[2:4])) and 100 * b >= 50 * a for q, b in found.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def made(seed, docs=60):
    g = random.Random(seed)
    words = ["a", "b", "Ab", "c", "ü", "É", "x\x00y", "日本", "1", "\x1c"]
    text = lambda: "".join(g.choice(words) + g.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ""]) for _ in range(g.randrange(0, 90)))
    return [(g.choice(["en", "de", None, "und", "", "en"]), text() if g.random() < 0.95 else None) for _ in range(docs)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, k1 int, WORD string, n int").repartition(3)
    return sorted(tuple(r) for r in co.collocations(df, bits=14, **kw).collect())


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rows = made(seed)
    assert run(spark, rows) == brute(rows)


def test_several_scans_and_ties_at_the_end(spark):
    rows = made(7, 150)
    assert run(spark, rows, slots=50, top=5) == brute(rows, top=5)


def test_vocabularies_that_end_early(spark):
    rows = made(9)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    few, many = (sorted(tuple(r) for r in co.count_phrases(df, bits=14, limit=k)[0].collect()) for k in (3, 10**6))
    assert few == many and few


def test_texts_of_more_words_than_are_packed(spark, monkeypatch):
    monkeypatch.setattr(co, "PACKED", 2)
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value

    class Docs:
        def mapInArrow(self, scan, schema):
            return pa.Table.from_batches(scan(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b c d e f g a b c"]})])))

    ones = co.BitTable(np.full(1 << 10, 255, np.uint8), 13)
    out = co.find_candidates(Docs(), 0, Held(ones), Held({2: ones, 3: ones}), 4).to_pylist()
    assert {r["lang"] for r in out} == {"en"} and len({r["share"] for r in out}) == len(out) <= 4
    key = lambda w: np.uint64(xxhash.xxh64_intdigest(co.word_prefix("en", 0) + w.encode(), 42)).view(np.int64).item()
    words = "a b c d e f g a b c".split()
    want = {tuple(map(key, words[i : i + k])) + (0,) * (3 - k) for k in (2, 3) for i in range(len(words) - k + 1)}
    assert sorted(k for r in out for k in zip(*np.frombuffer(r["keys"], np.int64).reshape(3, -1).tolist(), strict=True)) == sorted(want)


def test_slots_are_a_minimal_perfect_hash():
    g = np.random.default_rng(3)
    for n in (0, 1, 2, 3000):
        keys = g.integers(1, 1 << 63, (n, 3)).astype(np.uint64)
        keys[: n // 3, 1:] = 0
        keys[n // 3 : n // 2, 2] = 0
        table = co.PhraseSlots(keys)
        assert sorted(table.find(*keys.T).tolist()) == list(range(n))
        other = g.integers(1, 1 << 63, (2000, 3)).astype(np.uint64)
        assert (table.find(*other.T) == -1).all()
    with pytest.raises(ValueError):
        co.PhraseSlots(np.ones((2, 3), np.uint64))


def test_half_bytes():
    g = np.random.default_rng(5)
    table, plain = np.zeros(32, np.uint8), np.zeros(64, np.int64)
    for _ in range(6):
        at = g.choice(64, 20, replace=False)
        n = g.integers(1, 6, 20)
        co.add_to_halves(table, at, n, 10)
        plain[at] = np.minimum(plain[at] + n, 10)
    assert co.from_halves(table).tolist() == plain.tolist() and co.in_halves(co.from_halves(table)).tolist() == table.tolist()


def test_word_keys_agree(spark):
    v = co.Vocabulary("dé", 3)
    numbers = v.numbers(["Ein  ü\tWORT", "x"])
    assert numbers.tolist() == [1, 2, 3, 0, 4] and list(v) == [b".", b"ein", "ü".encode(), b"wort", b"x"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("dé", w.decode()) for w in list(v)[1:]], "lang string, word string")
    assert [r[0] for r in df.select(co.spark_word_key(F.col("lang"), F.col("word"), 3)).collect()] == v.keys().view(np.int64)[1:].tolist()


def test_keys_that_meet_get_another_salt(spark, monkeypatch):
    """Under the first salt all words share a key."""
    honest = co.spark_word_key
    monkeypatch.setattr(co, "spark_word_key", lambda lang, word, salt: honest(lang, word, salt) if salt else honest(lang, lang, 0))
    rows = made(4)
    assert run(spark, rows) == brute(rows)


def test_least_counts_above_a_half_byte(spark):
    rows = made(12, 150)
    assert run(spark, rows, least=23) == brute(rows, least=23)


def test_odd_rows(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("en", ""), ("en", " \t.,")]) == []
    rows = [("en", "Hot Word " * 5000), ("en", "hot word. " * 30), (None, "a b " * 11)] * 3
    assert run(spark, rows) == brute(rows)


def test_three_scans_however_many_candidates(spark, monkeypatch):
    """Full buckets rule nothing out and a share holds few: still three scans, and tasks hand on what they gathered."""
    monkeypatch.setattr(co, "GATHERED", 40)
    rows = made(21, 150)
    df, scans = spark.createDataFrame(rows, "lang string, text string").coalesce(2), []
    cls = type(df)
    plain = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, *a, **kw: scans.append(1) or plain(self, *a, **kw))
    out = sorted(tuple(r) for r in co.collocations(df, bits=3, slots=10).collect())
    assert out == brute(rows) and len(scans) == 3
