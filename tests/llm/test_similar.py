"""The pipeline's near-duplicate stage against the shares of all pairs."""

import numpy as np
import pytest

import corpus_pipeline as cp
from claimloom.llm import similar


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def least_of_groups(rows):
    sets, group = [five(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


@pytest.mark.parametrize("chunk", [2048, 16])
def test_pairs_around_the_share(spark, tmp_path, chunk):
    g = np.random.default_rng(2)
    rows = []
    for i in range(120):  # the last k of 200 shingles differ: shares from 0.67 to 1
        w = [f"w{x}" for x in g.integers(0, 9000, 204)]
        k = i % 40
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 204 - k] + [f"v{x}" for x in range(k)]))]
    base = [f"b{x}" for x in range(150)]  # a large group, and a text without a partner in it
    for i in range(300):
        v = list(base)
        v[int(g.integers(0, 150))] = f"n{i}"
        rows.append((1000 + i, " ".join(v)))
    rows += [(2000, " ".join(base[:75] + [f"z{i}" for i in range(75)])), (2001, ""), (2002, " "), (2003, "a b"), (2004, "A B")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = similar.keep_one_of_similar(spark.read.parquet(str(tmp_path / "d")), chunk_rows=chunk, chunk_bytes=1 << 18)
    assert sorted(r.doc_id for r in got.collect()) == least_of_groups(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, sf).collect()) == least_of_groups(rows)
    assert cp.drop_near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_chunks_of_one_shard():
    """Points that are asked about are compared with the other points of their shard, and only across components."""
    g = np.random.default_rng(4)
    base = np.unique(g.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [np.unique(np.r_[base[: 400 - k], g.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in range(0, 200, 4)]
    fp = np.array([similar.fingerprint(s) for s in sets], np.int64).view(np.uint64)
    shard, n = np.zeros(len(sets), np.int64), len(sets)
    true = {(i, j) for i in range(n) for j in range(i) if similar.similar(sets[i], sets[j])}
    found = similar.links(fp, shard, sets, np.arange(n))
    assert set(found) <= true
    asks = np.arange(n) % 2 == 0
    label = np.where(asks, np.arange(n), 1)
    across = similar.links(fp, shard, sets, label, asks)
    assert all(asks[a] and not asks[b] for a, b in across)
    assert {a for a, _ in across} == {i for i in range(n) if asks[i] and any(((i, j) in true or (j, i) in true) and not asks[j] for j in range(n))}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "Two words"), (6, "a b c d e"), (7, "A B C D E"), (7, "A B C D E"), (None, "é È ɐ"), (9, "x " * 30000)]
    edge = spark.createDataFrame([(*r, 1, "x", 5, None) for r in rows], "doc_id long, text string, rid int, node string, n int, bands string")
    kept = similar.keep_one_of_similar(edge).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 9), (True, 0)]
    assert kept[0].asDict().keys() == set(edge.columns)
    assert similar.keep_one_of_similar(edge.limit(0)).count() == 0
