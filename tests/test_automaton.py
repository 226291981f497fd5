"""The automaton over token classes against a search of every span by regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from claimloom.operators import automaton as A
from claimloom.operators import matching as M

WORDS = ["a", "b", "c", "d"]


def catalogue(g, patterns, predicates):
    """Patterns of the shape that catalogues have: lists of values, all quantifiers."""
    values = [tuple(g.sample(WORDS, g.randrange(1, 4))) for _ in range(predicates)]
    out = []
    for k in range(patterns):
        steps = [({"TEXT": {"IN": list(g.choice(values))}} | ({"POS": g.choice("xy")} if g.random() < 0.4 else {}) if g.random() < 0.9 else {}) | {"OP": g.choice(["", "", "+", "*", "?", "1"])} for _ in range(g.randrange(1, 6))]
        out.append(M.compile_pattern(f"t{k}", k, steps, []))
    return out


def brute(patterns, units, most=None):
    out = set()
    symbols = [(w, p) for w in [*WORDS, None] for p in ("x", "y", None)]
    code = {s: chr(0x4E00 + i) for i, s in enumerate(symbols)}
    for k, p in enumerate(patterns):
        meets = lambda s, need: all(({"text": s[0], "pos": s[1]}[p.predicates[i][0]]) in p.predicates[i][1] for i in need)
        shape = "".join("(?:" + ("[" + "".join(code[s] for s in symbols if meets(s, need)) + "]" if any(meets(s, need) for s in symbols) else "(?!)") + ")" + op for need, op in p.steps)
        bound = most if most is not None and p.most is None else None
        for u, unit in enumerate(units):
            text = "".join(code[s] for s in unit)
            for a in range(len(text)):
                for b in range(a + 1, len(text) + 1 if bound is None else min(len(text), a + bound) + 1):
                    if re.fullmatch(shape, text[a:b]):
                        out.add((k, u, a, b))
    return out


def found(auto, units, most=None):
    flat = [s for u in units for s in u]
    columns = {"text": pa.array([s[0] for s in flat], pa.string()), "pos": pa.array([s[1] for s in flat], pa.string())}
    n = np.array([len(u) for u in units], np.int64)
    ends = np.cumsum(n)
    got = auto.find(auto.classes_of({a: columns[a] for a in auto.values}, len(flat)), np.repeat(ends, n), most)
    unit = np.searchsorted(ends, got[1], side="right")
    rows = [(k, u, a - (ends - n)[u], b - (ends - n)[u]) for k, u, a, b in zip(got[0].tolist(), unit.tolist(), got[1].tolist(), got[2].tolist(), strict=True)]
    assert len(rows) == len(set(rows))
    return set(rows)


def units_of(g, count, longest):
    return [[(g.choice([*WORDS, None]), g.choice(["x", "y", None])) for _ in range(g.randrange(0, longest))] for _ in range(count)]


@pytest.mark.parametrize("seed", range(12))
def test_all_matches(seed):
    """28 patterns with up to 20 predicates at once; tables serve several batches."""
    g = random.Random(seed)
    patterns = catalogue(g, 28, 20)
    auto = A.Automaton(patterns)
    assert len(auto.predicates) > 9
    for _ in range(3):
        units = units_of(g, 12, 14)
        assert found(auto, units) == brute(patterns, units)
        assert found(auto, units, 4) == brute(patterns, units, 4)


def test_tables_that_start_anew(monkeypatch):
    monkeypatch.setattr(A, "MOST_STATES", 2)
    g = random.Random(99)
    patterns = catalogue(g, 10, 9)
    auto = A.Automaton(patterns)
    for _ in range(4):
        units = units_of(g, 8, 10)
        assert found(auto, units) == brute(patterns, units)


def test_more_predicates_than_bits(monkeypatch):
    """Eighty predicates; a wide product of attribute values."""
    patterns = [M.compile_pattern(f"t{k}", k, [{"TEXT": f"w{k}", "OP": "+"}, {"LEMMA": f"l{k}"}], []) for k in range(40)]
    patterns += [M.compile_pattern("e", 40, [{"ENT_TYPE": {"IN": [f"e{i}" for i in range(1200)]}, "POS": {"IN": [f"p{i}" for i in range(900)]}}], [])]
    auto = A.Automaton(patterns)
    text, lemma = ["w3", "w3", "x", "w39", "q"], ["a", "l3", "l3", "l3", "l39"]
    columns = {"text": pa.array(text), "lemma": pa.array(lemma), "ent_type": pa.array(["e5", None, "e9", "z", "e0"]), "pos": pa.array(["p8", "p1", "z", "p1", "p0"])}
    got = auto.find(auto.classes_of(columns, 5), np.full(5, 5))
    # w3 w3/l3: the second token is a w3 with lemma l3 after one w3; w3 at 1 has lemma l3, so (0, 2)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted([(3, 0, 2), (3, 1, 3), (3, 0, 3), (39, 3, 5), (40, 0, 1), (40, 4, 5)])


def test_nothing():
    auto = A.Automaton([])
    assert [len(x) for x in auto.find(auto.classes_of({}, 3), np.full(3, 3))] == [0, 0, 0]
    auto = A.Automaton(catalogue(random.Random(1), 3, 2))
    assert found(auto, []) == set() and found(auto, [[]]) == set()
