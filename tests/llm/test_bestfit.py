"""Best-fit packing: every id once, gapless sequences, few of them; runs and shares against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from claimloom.llm import bestfit
from claimloom.llm.packing import encoder
from claimloom.llm.queries import op12_best_fit, tokenizer_path


def best_fit_decreasing(lengths, sequence):
    """Sequences used if every piece, the longest first, goes to the fullest one with room."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(sequence - n)
    return len(room)


def expanded(rows):
    """(length, rank, sequence, place) of every document of placement rows."""
    return [(size, first + i, seq + i // each, at + i % each * size) for kind, size, first, n, seq, each, at in rows if kind == 2 for i in range(n)]


@pytest.mark.parametrize("seed", range(20))
def test_sweep_is_best_fit_decreasing(seed):
    g = random.Random(seed)
    sequence = g.choice([16, 100])
    count = Counter(g.randrange(1, sequence + 1) for _ in range(g.randrange(1, 200)))
    rows = bestfit.sweep([(n, 0, k) for n, k in count.items()], [], sequence, 0)
    put = expanded(rows)
    assert Counter((n, r) for n, r, *_ in put) == Counter((n, r) for n, k in count.items() for r in range(k))
    used = {}
    for n, _, seq, at in put:
        used.setdefault(seq, []).append((at, n))
    for parts in used.values():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends <= sequence
    assert len(used) == best_fit_decreasing(count.elements(), sequence)
    left = Counter({k: 0 for k in ()})
    for kind, size, _, n, *_ in rows:
        left[size] += n if kind == 1 else 0
    full = [sequence - sum(n for _, n in parts) for parts in used.values()]
    assert +left == Counter(x for x in full if x)


def test_sweep_without_new_sequences():
    rows = bestfit.sweep([(5, 0, 4), (3, 0, 3)], [(11, 100, 1), (4, 7, 1)], 12, None)
    assert sorted(expanded(rows)) == [(3, 0, 7, 8), (5, 0, 100, 1), (5, 1, 100, 6)]
    assert {r[:4] for r in rows if r[0] == 0} == {(0, 5, 2, 2), (0, 3, 1, 2)}
    assert sorted(r[1] for r in rows if r[0] == 1) == [1, 1]


@pytest.mark.parametrize("seed", range(10))
def test_gaps_are_dealt_once(seed):
    g = random.Random(seed)
    there = {r: 0 for r in (-1, 0, 1, 2)}
    tables = {r: pd.DataFrame([(1, g.randrange(10, 90), 1000 * k, g.randrange(1, 9)) for k in range(g.randrange(1, 6))], columns=["kind", "size", "first", "n"]) for r in there}
    there = {r: int((t["size"] * t["n"]).sum()) for r, t in tables.items()}
    shares = bestfit.shares_of({p: g.randrange(1, 900) for p in (0, 1, 2)}, there)
    for r, t in tables.items():
        dealt = bestfit.deal_gaps(t, shares[r])
        one = lambda df: sorted((s, f + i) for s, f, n in df[["size", "first", "n"]].itertuples(index=False) for i in range(n))
        assert one(dealt) == one(t) and all(to == -1 or to >= r for to in dealt["to"])
        assert all(a[1] <= b[0] for a, b in zip(shares[r], shares[r][1:], strict=False))


def test_joined_ranges():
    assert bestfit.joined_ranges({0: 5, 1: 5, 2: 5, 3: 5}, 10, 4) == [0, 0, 2, 2]
    assert bestfit.joined_ranges({0: 30}, 10, 3) == [0, 0, 0]
    assert bestfit.joined_ranges({}, 10, 3) == [0, 0, 0]
    assert bestfit.joined_ranges({0: 20, 2: 9}, 10, 3) == [0, 0, 0]


def check(pdf, docs, sequence):
    tool = encoder(tokenizer_path())
    want = Counter()
    for doc, text in docs:
        ids = np.frombuffer(tool.encode_whole(text or ""), "<u4").tolist() + [1]
        for k, i in enumerate(range(0, len(ids), sequence)):
            part = ids[i : i + sequence]
            want[(doc, k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((None if pd.isna(d) else int(d), *map(int, r)) for d, *r in pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, rows in pdf.sort_values("offset").groupby("sequence_id"):
        ends = (rows.offset + rows.length).to_numpy()
        assert rows.offset.to_numpy().tolist() == [0, *ends[:-1].tolist()] and ends[-1] <= sequence
    return pdf.sequence_id.nunique()


def test_query(spark, sf):
    pdf = op12_best_fit(spark, sf).toPandas()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used = check(pdf, docs, 4096)
    assert used <= -(-int(pdf.length.sum()) // 4096) * 1.02 + 1 and used <= best_fit_decreasing(pdf.length.tolist(), 4096) + 1


@pytest.mark.parametrize("least", [1, 64])
def test_skew_and_ranges(spark, monkeypatch, least):
    """A third of all documents alike, many empty ones, and ranges that are swept apart."""
    monkeypatch.setattr(bestfit, "LEAST_SEQUENCES", least)
    g = random.Random(1)
    docs = [(i, " ".join(["a"] * g.choice([0, 0, 20, 20, 20, g.randrange(60), g.randrange(140)]))) for i in range(600)]
    pdf = bestfit.pack_best_fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), tokenizer_path(), sequence=64).toPandas()
    used = check(pdf, docs, 64)
    assert used <= best_fit_decreasing(pdf.length.tolist(), 64) * 1.03 + 8
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pdf.itertuples())


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (3, "word " * 9000), (3, "word " * 9000), (4, " \t")]
    df = spark.createDataFrame([(*r, 5, "x", 2, 3, None, 1) for r in rows], "doc_id long, text string, Offset int, IDS string, rid int, rank int, place string, part int")
    out = bestfit.pack_best_fit(df, tokenizer_path(), with_ids=False)
    assert {"rid", "rank", "place", "part"} <= set(out.columns) and "Offset" not in out.columns
    check(out.toPandas(), rows, 4096)
    assert bestfit.pack_best_fit(df.where("false"), tokenizer_path()).collect() == []
