"""The prefix trie of conversations against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from claimloom.llm.prefixtrie import paths_of, prefix_trie, rebuilt, turns_of, with_last_turns

SCHEMA = "conv_id long, turn long, role string, text string, depth int, X1 string, place string, digest int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    return {c: tuple((t[2], t[4]) for t in sorted(v)) for c, v in own.items()}


def rebuilt_brute(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), ())[:h] + turns[h:]
    return out


def trie_brute(convs):
    members, kids, out = defaultdict(set), defaultdict(set), {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        saved = (n - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(convs[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        leaves = sum(out[k][5] for k in kids[path]) if path in kids else 1
        out[path] = (min(members[path]), len(path), parent, n, len(kids.get(path, ())), leaves, saved + sum(out[k][6] for k in kids.get(path, ())), hashlib.sha256(ends.encode()).hexdigest())
    return out


def collected(trie):
    return sorted((tuple(r) for r in trie.select(COLUMNS).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 3) for r in rows], SCHEMA)


def random_rows(seed, convs=150):
    g = random.Random(seed)
    texts = ["a", "a b", "", None, "ü  é\x0bz", "b"]
    return [(c, k if g.random() < 0.9 else None, g.choice(["user", "assistant", None]) if g.random() < 0.2 else "user", g.choice(texts)) for c in g.sample(range(-60, 300), convs) for k in range(g.randrange(1, 7))]


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rows = random_rows(seed)
    want = trie_brute(rebuilt_brute(ordered(rows)))
    assert collected(prefix_trie(rebuilt(turns_of(frame(spark, rows))), fan=2)) == sorted(want.values(), key=str)


def test_as_they_are_with_texts(spark):
    rows = random_rows(5, 60)
    paths = paths_of(turns_of(frame(spark, rows), keep=("role", "text")))
    trie = prefix_trie(paths)
    want = trie_brute(ordered(rows))
    assert collected(trie) == sorted(want.values(), key=str)
    got = sorted((r.conv_id, r.depth, r.role, r.text) for r in with_last_turns(trie, paths).where("depth > 0").collect())
    assert got == sorted((v[0], v[1], *p[-1]) for p, v in want.items() if p)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"), (7, 2, "user", "long " * 20000), (41, 1, "u", "v"), (61, 1, "u", "v"), (81, 0, "u", "v")]
    want = trie_brute(rebuilt_brute(ordered(rows)))
    assert collected(prefix_trie(rebuilt(turns_of(frame(spark, rows))))) == sorted(want.values(), key=str)
    assert collected(prefix_trie(rebuilt(turns_of(frame(spark, []))))) == []


def test_long_and_common(spark):
    """A conversation with a third of all turns, and a third of all conversations alike."""
    rows = [(5, k, "user", f"t {k % 7}") for k in range(3000)] + [(c, k, "user", "same") for c in range(1000, 2500) for k in range(2)] + [(c, 0, "user", f"own {c}") for c in range(5000, 8000)]
    want = trie_brute(ordered(rows))
    assert collected(prefix_trie(paths_of(turns_of(frame(spark, rows))))) == sorted(want.values(), key=str)
