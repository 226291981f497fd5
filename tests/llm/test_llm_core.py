"""Sharding, near duplicates, decontamination and packing against brute force."""

import hashlib
import re
import tempfile
import zlib

import numpy as np
import pytest
import xxhash

from claimloom.llm import decontaminate as dc
from claimloom.llm import neardup as nd
from claimloom.llm import packing, sharding

ROWS = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "Two words"), (6, "a b c d e"), (7, "A B C D E"), (7, "A B C D E"), (None, "é È ɐ"), (9, "x " * 30000)]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in ROWS], "doc_id long, text string, shard int, FP string, found string")
    return df


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_matrix_rows_add_up():
    ends = np.r_[0, np.cumsum([5, 0, 17, 3, 40])]
    sizes = sharding.shard_sizes(65, 4)
    rows = np.array([sharding.matrix_row(i, ends, sizes, 1) for i in range(5)])
    assert sizes.tolist() == [17, 16, 16, 16] and (rows.sum(1) == np.diff(ends)).all() and (rows.sum(0) == sizes).all()


def test_matrix_is_hypergeometric():
    """Counts of one cell over many seeds against the chances of the hypergeometric law."""
    from math import comb

    ends, sizes = np.r_[0, np.cumsum([6, 9, 5])], np.array([7, 7, 6])
    cell = [int(sharding.matrix_row(1, ends, sizes, s)[0]) for s in range(6000)]
    chance = [comb(9, k) * comb(11, 7 - k) / comb(20, 7) for k in range(8)]
    seen = np.bincount(cell, minlength=8) / len(cell)
    assert np.abs(seen - chance).max() < 4 * np.sqrt(max(chance) / len(cell))


def test_large_hypergeometric_is_unbiased():
    g = np.random.default_rng(0)
    x = [sharding.hypergeometric(g, 3 * 10**9, 10**9, 1000) for _ in range(2000)]
    assert abs(np.mean(x) - 750) < 3 and 11 < np.std(x) < 17


def test_shards_exact_and_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = sharding.assign_shards(docs, 24)
    p = out.toPandas()
    assert sorted(p.doc_id) == sorted(r[0] for r in docs.select("doc_id").collect())
    n = p.groupby("shard").size()
    assert len(n) == 24 and n.max() - n.min() <= 1
    for _, g in p.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.assign_shards(docs, 24).toPandas()
    assert sorted(zip(again.doc_id, again.shard, again.slot)) == sorted(zip(p.doc_id, p.shard, p.slot))
    assert np.corrcoef(p.doc_id, p.shard * 1000 + p.slot)[0, 1] < 0.3


def test_shard_query_brute(spark, sf):
    from claimloom.llm.queries import op1_shard

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_shard(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)


def test_places_are_uniform(spark):
    """Each of 12 rows comes to each of 12 places about equally often, over seeds and whatever its partition."""
    d = spark.range(12, numPartitions=3).withColumnRenamed("id", "doc_id")
    d.write.mode("overwrite").parquet(path := f"{tempfile.mkdtemp()}/d")
    d, n, runs = spark.read.parquet(path), np.zeros((12, 12)), 60
    for seed in range(runs):
        for r in sharding.assign_shards(d, 3, seed=seed, least_blocks=6).collect():
            n[r.doc_id, r.shard * 4 + r.slot] += 1
    assert (n.sum(0) == runs).all() and ((n - runs / 12) ** 2 / (runs / 12)).sum() < 121 + 5 * np.sqrt(2 * 121)


def test_a_row_that_comes_and_goes_raises(spark):
    """An input that gives other rows in each pass."""
    import random

    from pyspark.sql import functions as F

    some = F.udf(lambda: random.random() < 0.5, "boolean").asNondeterministic()
    with pytest.raises(Exception, match="deterministic scan|out of bounds"):
        sharding.assign_shards(spark.range(1000, numPartitions=1).withColumnRenamed("id", "doc_id").where(some()), 3).collect()


def test_shards_edges(spark, edge):
    p = sharding.assign_shards(edge, 24).toPandas()
    assert len(p) == len(ROWS) and set(p.slot) == {0} and p.shard.is_unique
    assert sharding.assign_shards(edge.limit(0), 3).count() == 0


def brute_fp(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    comp = list(range(len(ids)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("rows", [2048, 4])
def test_near_duplicates_brute(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in nd.near_duplicates(docs, shard_rows=rows).collect()}
    all_ = docs.collect()
    fps = [brute_fp(r.text) for r in all_]
    comp = brute_components([r.doc_id for r in all_], fps)
    assert {r.doc_id: (f, c) for r, f, c in zip(all_, fps, comp)} == got


def test_bk_forest_finds_all_links(spark):
    g = np.random.default_rng(3)
    base = g.integers(0, 1 << 63, 6, dtype=np.uint64)
    pts = np.unique([int(base[i % 6]) ^ sum(1 << int(b) for b in g.integers(0, 64, i % 4)) for i in range(400)]).astype(np.uint64)
    forest = nd.BKForest(pts, np.zeros(len(pts), np.int64))
    q, p = forest.within(pts, forest.root, 3)
    want = {(i, j) for i in range(len(pts)) for j in range(len(pts)) if (int(pts[i]) ^ int(pts[j])).bit_count() <= 3}
    assert set(zip(q.tolist(), p.tolist())) == want
    df = spark.createDataFrame([(0, int(x.view(np.int64)), int(x.view(np.int64))) for x in pts], "which int, fp long, node long")
    from claimloom.llm.common import Stash

    for rows in (2048, 16):
        stash = Stash(spark)
        roots = {r.a: r.b for r in nd.connected(nd.link_fingerprints(df, stash, rows), stash).collect()}
        signed = [r.fp for r in df.collect()]
        comp = brute_components(signed, [x % (1 << 64) for x in signed])
        assert [roots.get(x, x) for x in signed] == comp


def test_chain_component(spark):
    from claimloom.llm.common import Stash

    edges = spark.createDataFrame([(i, i - 1) for i in range(2, 60)] + [(i, 1000) for i in range(1001, 1400)], "a long, b long")
    out = {r.a: r.b for r in nd.connected(edges, Stash(spark)).collect()}
    assert out == {i: 1 for i in range(2, 60)} | {i: 1000 for i in range(1001, 1400)}


def test_more_fingerprints_find_edited_copies(spark):
    g = np.random.default_rng(1)
    rows, n = [], 40
    for i in range(n):
        w = [f"w{x}" for x in g.integers(0, 3000, 250)]
        v = list(w)
        for j in g.integers(0, 250, 3):
            v[j] = f"new{j}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {k: nd.near_duplicates(df, count=k).select("component_root").distinct().count() for k in (1, 8)}
    assert n <= groups[8] < groups[1] and groups[8] <= 1.1 * n
    got = nd.near_duplicates(df, count=8).collect()
    assert all(r.component_id // 2 == r.doc_id // 2 for r in got)


def test_near_duplicates_edges(spark, edge):
    out = nd.near_duplicates(edge).collect()
    fps = [brute_fp(t) for _, t in ROWS]
    assert sorted((r.fp % (1 << 64) for r in out)) == sorted(fps)
    assert {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert nd.near_duplicates(edge.limit(0)).count() == 0


def brute_hits(text, items, window=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = norm(text), set(), set()
    for item, t in items:
        p = norm(t)
        n = min(window, len(p))
        if not n:
            continue
        pats = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in pats:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


def test_decontaminate_brute(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    want = {r.doc_id: brute_hits(r.text, items) for r in docs.collect()}
    assert any(h for _, h, _ in want.values())
    for most in (dc.BROADCAST_WINDOWS, 300):
        got = {r.doc_id: (r.found.n_words, r.found.n_hit, list(r.found["items"])) for r in dc.decontaminate(docs, bench, most=most).collect()}
        assert got == want


def test_wu_manber_random():
    g = np.random.default_rng(5)
    for _ in range(60):
        text = " ".join(g.choice(list("abc"), 200))
        items = [(str(i), " ".join(g.choice(list("abcd"), g.integers(0, 14)))) for i in range(12)]
        n, spans, found = dc.scan(text, dc.build(items, 10))
        assert (n, sum(b - a for a, b in spans), found) == brute_hits(text, items)


def test_tables_stay_small():
    import pickle

    g = np.random.default_rng(6)
    items = [(str(i), " ".join(f"w{x}" for x in g.integers(0, 5000, 200))) for i in range(1000)]
    assert len(pickle.dumps(dc.build(items, 10))) < 50 * 191 * 1000


def test_decontaminate_edges(spark, edge):
    bench = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (None, "one"), (1, "d")], "item_id long, text string")
    out = {(r.doc_id, r.text): r.found for r in dc.decontaminate(edge, bench).collect()}
    assert out[1, None].n_words == 0 and out[4, "one"]["items"] == ["null"]
    assert (out[6, "a b c d e"].n_hit, out[6, "a b c d e"]["items"]) == (3, ["1"])
    none = dc.decontaminate(edge, bench.limit(0)).collect()
    assert {r.found.n_hit for r in none} == {0}
    assert dc.decontaminate(edge.limit(0), bench).count() == 0


def test_first_fit_decreasing_brute():
    g = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 333):
        sizes = g.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (k, 100 - room[k])
            room[k] -= sizes[i]


def check_packing(p, docs, size=2048):
    from tokenizers import Tokenizer

    from claimloom.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= size
    want = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, s, len(ids[s : s + size]), zlib.crc32(np.array(ids[s : s + size], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), size)]
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in p.itertuples()]
    assert sorted(got, key=lambda r: str(r)) == sorted(want, key=lambda r: str(r))


@pytest.mark.parametrize("with_ids", [False, True])
def test_packing(spark, sf, with_ids):
    from claimloom.llm.queries import tokenizer_path

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    p = packing.pack(docs, tokenizer_path(), with_ids=with_ids).toPandas()
    check_packing(p, [tuple(r) for r in docs.collect()])
    assert p.length.sum() / (p.sequence_id.nunique() * 2048) > 0.97
    if with_ids:
        assert (p.ids.map(lambda x: zlib.crc32(x)) == p.ids_crc32).all()


def test_packing_edges(spark, edge):
    from claimloom.llm.queries import tokenizer_path

    odd = [(20, "İstanbul ΣΑΣ ſ K it's I'LL 12 a1b2 <|endoftext|> x<|startoftext|>y"), (21, "a\x1cb  c　d ​ é ｆｕｌｌ"), (22, "don't,, ''s ... naïve—ß ǅ ª º ŉ")]
    df = edge.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    p = packing.pack(df, tokenizer_path(), with_ids=False).toPandas()
    check_packing(p, ROWS + odd)
    assert packing.pack(edge.limit(0), tokenizer_path()).count() == 0


def test_packing_with_clashing_names(spark):
    from claimloom.llm.queries import tokenizer_path

    d = spark.createDataFrame([(1, "a b", 7, 8, 9, "x", 5), (2, None, 7, 8, 9, "y", 5), (2, "a b", 7, 8, 9, "y", 5)], "doc_id long, text string, start int, length int, offset int, sequence_id string, ids int")
    p = packing.pack(d, tokenizer_path(), with_ids=False).toPandas()
    check_packing(p, [(1, "a b"), (2, None), (2, "a b")])


def test_items_digest(spark, sf):
    from claimloom.llm.queries import op6_decontaminate

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in op6_decontaminate(spark, sf).collect():
        n, hit, found = brute_hits(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
