"""All token patterns as one automaton over classes of tokens, made deterministic only where texts lead.

A token's class is the set of the patterns' predicates that it meets. A set of (pattern, step) pairs is a state; a state's
successor by a class is worked out the first time that a text asks for it and looked up after that. All places of a batch
are followed at once: each round takes one more token for those that are still alive, so a match costs its length and a
place where nothing begins costs one look-up. Patterns that begin with an open quantifier and end without are followed from
their ends, where one run of tokens has one end rather than many starts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Places that are followed one by one rather than together.
FEW = 8
#: States after which a table starts anew; texts rarely lead to more than some hundreds.
MOST_STATES = 4096


@dataclass(frozen=True)
class Pattern:
    template: str
    pattern_id: int
    #: distinct predicates: (attribute, values)
    predicates: tuple[tuple[str, tuple[str, ...]], ...]
    #: (numbers of the predicates that a token has to meet, quantifier) of each step
    steps: tuple[tuple[tuple[int, ...], str], ...]

    @property
    def least(self) -> int:
        return sum(op in ("", "+") for _, op in self.steps)

    @property
    def most(self) -> int | None:
        """The longest match; None if a quantifier is open."""
        return None if any(op in ("+", "*") for _, op in self.steps) else len(self.steps)

    @property
    def from_end(self) -> bool:
        return bool(self.steps) and self.steps[0][1] in ("+", "*") and self.steps[-1][1] not in ("+", "*")


class Table:
    """A deterministic automaton that grows as it is used. State 0 is dead."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, str]]]]):
        """patterns: (number, steps), a step being the bits that a token must have, and a quantifier."""
        self.steps, self.final, starts = [], {}, []
        for number, steps in patterns:
            first = len(self.steps)
            self.steps += [*steps, (0, "end")]
            self.final[len(self.steps) - 1] = number
            starts.append(first)
        self.start = frozenset(x for s in starts for x in self.skips(s))
        self.clear()

    def clear(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.next = np.full((16, 16), -1, np.int32)
        self.known: dict[tuple[int, int], int] = {}
        self.ends: list[list[int]] = []
        self.state(frozenset())
        self.first = self.state(self.start)

    def skips(self, at: int) -> Iterable[int]:
        """This step and those that may come instead, past optional ones."""
        yield at
        while self.steps[at][1] in ("?", "*"):
            at += 1
            yield at

    def state(self, steps: frozenset[int]) -> int:
        if steps not in self.number:
            self.number[steps] = len(self.sets)
            self.sets.append(steps)
            self.ends.append(sorted(self.final[s] for s in steps if s in self.final))
            if len(self.sets) > len(self.next):
                self.next = np.r_[self.next, np.full_like(self.next, -1)]
        return self.number[steps]

    def follow(self, state: int, bits: int) -> int:
        out: set[int] = set()
        for s in self.sets[state]:
            need, op = self.steps[s]
            if op != "end" and need & bits == need:
                out.update(self.skips(s + 1))
                if op in ("+", "*"):
                    out.add(s)
        return self.state(frozenset(out))

    def step(self, states: np.ndarray, classes: np.ndarray, bits: list[int]) -> np.ndarray:
        """Successors of the states by the classes; bits: each class's predicates."""
        while len(bits) > self.next.shape[1]:
            self.next = np.c_[self.next, np.full_like(self.next, -1)]
        out = self.next[states, classes]
        new = out < 0
        if new.any():
            for key in np.unique(states[new].astype(np.int64) << 32 | classes[new]).tolist():
                s, c = key >> 32, key & 0xFFFFFFFF
                to = self.follow(s, bits[c])
                self.next[s, c] = to
            out = self.next[states, classes]
        return out


class Automaton:
    """Finds all matches of patterns in tokens given by columns of attributes."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns = patterns
        self.predicates = list(dict.fromkeys(p for pattern in patterns for p in pattern.predicates))
        number = {p: k for k, p in enumerate(self.predicates)}
        self.values: dict[str, dict[str, int]] = {}
        for k, (attribute, values) in enumerate(self.predicates):
            for v in values:
                own = self.values.setdefault(attribute, {})
                own[v] = own.get(v, 0) | 1 << k
        bits = [[(sum(1 << number[p.predicates[k]] for k in need), op) for need, op in p.steps] for p in patterns]
        self.tables = [Table([(k, steps[::-1] if back else steps) for k, steps in enumerate(bits) if patterns[k].from_end == back]) for back in (False, True)]
        self.bits: list[int] = [0]
        self.classes = {0: 0}

    def __reduce__(self):
        return Automaton, (self.patterns,)

    def classes_of(self, columns: dict[str, pa.Array], n: int) -> np.ndarray:
        """The class of each of n tokens; a null value meets no predicate."""
        key, sets = np.zeros(n, np.int64), [0]
        for attribute, values in self.values.items():
            column = columns[attribute]
            masks = [0, *values.values()]
            at = np.asarray(pc.fill_null(pc.index_in(column, value_set=pa.array(list(values), column.type)), -1)).astype(np.int64) + 1
            key = key * len(masks) + at
            if len(sets) * len(masks) > 1 << 20:  # keep the keys small: only those that are there
                there, key = np.unique(key, return_inverse=True)
                sets = [sets[k // len(masks)] | masks[k % len(masks)] for k in there.tolist()]
            else:
                sets = [a | b for a in sets for b in masks]
        there = np.flatnonzero(np.bincount(key, minlength=len(sets))) if n else np.empty(0, np.int64)
        known = np.zeros(len(sets), np.int64)
        for k in there.tolist():
            if sets[k] not in self.classes:
                self.classes[sets[k]] = len(self.bits)
                self.bits.append(sets[k])
            known[k] = self.classes[sets[k]]
        return known[key]

    def find(self, classes: np.ndarray, ends: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pattern, first and last (exclusive) place of every match. ends: for each place the end of its unit.

        most bounds matches of patterns with an open quantifier.
        """
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(classes)
        for back, table in enumerate(self.tables):
            if not table.start:
                continue
            if len(table.sets) > MOST_STATES:
                table.clear()
            if back:  # the units mirrored: place i becomes n - 1 - i
                seen = classes[::-1]
                stop = n - self._starts(ends)[::-1]
            else:
                seen, stop = classes, ends
            limit = None if most is None else max([most, *(p.most or 0 for p in self.patterns)])
            place, states, length = np.arange(n), np.full(n, table.first, np.int32), 0
            while len(place) > FEW:
                states = table.step(states, seen[place + length], self.bits)
                length += 1
                alive = states > 0
                place, states = place[alive], states[alive]
                out += self._ended(table, place, states, length, back, n, most)
                if limit is not None and length >= limit:
                    break
                inside = place + length < stop[place]
                place, states = place[inside], states[inside]
            else:
                out += self._alone(table, seen, stop, place.tolist(), states.tolist(), length, limit, back, n, most)
        if not out:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _alone(self, table: Table, seen: np.ndarray, stop: np.ndarray, places: list[int], states: list[int], length: int, limit: int | None, back: int, n: int, most: int | None) -> list[tuple[np.ndarray, ...]]:
        """The last places that are alive, one after the other: a round for a handful would cost more than their tokens."""
        found: dict[tuple[int, int], list[int]] = {}
        for place, s in zip(places, states, strict=True):
            end = int(stop[place]) if limit is None else min(int(stop[place]), place + limit)
            i = place + length
            for c in seen[i:end].tolist():
                i += 1
                to = table.known.get((s, c))
                if to is None:
                    to = table.known[s, c] = table.follow(s, self.bits[c])
                s = to
                if not s:
                    break
                if table.ends[s]:
                    found.setdefault((s, i - place), []).append(place)
        return [m for (s, k), at in found.items() for m in self._ended(table, np.array(at), np.full(len(at), s), k, back, n, most)]

    @staticmethod
    def _starts(ends: np.ndarray) -> np.ndarray:
        """For each place the start of its unit."""
        n = len(ends)
        new = np.r_[True, ends[1:] != ends[:-1]] if n else np.empty(0, bool)
        at = np.flatnonzero(new)
        return at[np.cumsum(new) - 1]

    def _ended(self, table: Table, place: np.ndarray, states: np.ndarray, length: int, back: int, n: int, most: int | None) -> list[tuple[np.ndarray, ...]]:
        """Matches that end after ``length`` tokens."""
        out = []
        has = np.array([bool(e) for e in table.ends])[states]
        for s in np.unique(states[has]).tolist():
            at = place[states == s]
            first, last = (n - at - length, n - at) if back else (at, at + length)
            for k in table.ends[s]:
                if most is None or self.patterns[k].most is not None or length <= most:
                    out.append((np.full(len(at), k), first, last))
        return out
