"""The corpus pipeline: each stage on what the one before kept, against the same operators by hand."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from claimloom.llm import decontaminate as dc


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    from claimloom.llm.common import Stash

    stash = Stash(spark)
    for _, f in cp.STAGES:
        out.append(stash(f(spark, out[-1], sf)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "neardup", "decontaminate", "pii", "pack"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_near_duplicates_leave_one_of_each(stages):
    """Against the shares of five-word shingles of all pairs."""
    before, after = stages[1].collect(), stages[2].collect()
    words = [r.text.encode().lower().split() for r in before]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in words]
    group = list(range(len(before)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(before):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values()) and len(after) < len(before)


def test_contaminated_documents_go(spark, sf, stages):
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    searchers = dc.build(bench, 10)
    hit = {r.doc_id for r in stages[2].collect() if dc.scan(r.text, searchers)[1]}
    assert hit and {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect()} - hit


def test_packing_holds_every_document(stages):
    from tokenizers import Tokenizer

    from claimloom.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes() for r in stages[4].collect()}
    got = {}
    for r in sorted(stages[5].collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
    assert got == want


def test_run_gives_the_last_stage(spark, sf, stages):
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(cp.run(spark, sf).collect()) == key(stages[5].collect())


def test_stages_survive_odd_rows(spark, sf):
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "x@y.com " * 5, "en", "s", 40, 1)], "doc_id long, text string, lang string, source string, n_chars long, fp int")
    docs = odd
    for _, f in cp.STAGES[:-1]:
        docs = f(spark, docs, sf)
        assert docs.columns == odd.columns
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= 1
    assert cp.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0
