"""Boolean trigram queries of regular expressions, and postings of the trigrams of a batch."""

from __future__ import annotations

import re._parser as sre
from itertools import product

import numpy as np

#: A query is a list of clauses that must all hold; a clause is a list of trigram sets, one of
#: which must be wholly present. No clause at all: the pattern has no mandatory trigram.
Query = list[list[frozenset[str]]]
#: Strings a part of a pattern may stand for before they are no longer told apart.
MOST_STRINGS, MOST_CHARS = 64, 12


def _class_chars(items) -> set[str] | None:
    """Characters of a bracket expression, lower case; None if there are many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MOST_CHARS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _clause(strings: set[str]) -> list[frozenset[str]] | None:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if not sets or frozenset() in sets else sorted(sets, key=sorted)


class _Walk:
    """Collects the clauses of a parsed pattern; ``exact`` holds what the current run may spell."""

    def __init__(self) -> None:
        self.clauses: Query = []
        self.exact: set[str] = {""}
        self.whole = True  # whether ``exact`` spells everything seen so far

    def flush(self) -> None:
        if (clause := _clause(self.exact)) is not None:
            self.clauses.append(clause)
        self.exact, self.whole = {""}, False

    def join(self, strings: set[str] | None) -> None:
        if strings is None:
            self.flush()
        elif len(self.exact) * len(strings) > MOST_STRINGS:
            self.flush()
            self.exact = set(strings) if len(strings) <= MOST_STRINGS else {""}
        else:
            self.exact = {a + b for a, b in product(self.exact, strings)}

    def walk(self, tree) -> None:
        for kind, value in tree:
            if kind is sre.LITERAL:
                self.join({chr(value).lower()})
            elif kind is sre.IN:
                self.join(_class_chars(value))
            elif kind is sre.SUBPATTERN:
                self.walk(value[3])
            elif kind is sre.BRANCH:
                self.branch(value[1])
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                self.repeat(*value)
            elif kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                continue
            else:
                self.join(None)

    def branch(self, options) -> None:
        parts = [spelled(x) for x in options]
        if all(strings is not None for strings, _ in parts):
            self.join(set().union(*(strings for strings, _ in parts)))
            return
        self.flush()
        clauses = [q[0] for _, q in parts if q]
        if len(clauses) == len(parts):  # one clause of every option: one of them must hold
            self.clauses.append([s for c in clauses for s in c])

    def repeat(self, low: int, high, tree) -> None:
        strings, query = spelled(tree)
        if strings is not None and (low, high) == (0, 1):
            self.join(strings | {""})
        elif strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            for _ in range(low):
                self.join(strings)
        else:
            self.flush()
            if low:
                self.clauses += query
                if strings is not None and (clause := _clause(strings)):
                    self.clauses.append(clause)


def spelled(tree) -> tuple[set[str] | None, Query]:
    """All strings a part may spell, if few, and else the clauses it demands."""
    walk = _Walk()
    walk.walk(tree)
    if walk.whole:
        return walk.exact, []
    walk.flush()
    return None, walk.clauses


def query_of(pattern: str, flags: int = 0) -> Query:
    """Trigram query that holds in every text the pattern matches; letters are lower-cased."""
    walk = _Walk()
    walk.walk(sre.parse(pattern, flags))
    walk.flush()
    return walk.clauses


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Postings:
    """Which rows of a batch hold which of the trigrams that queries ask for."""

    def __init__(self, queries: list[Query]) -> None:
        grams = sorted({g for q in queries for c in q for s in c for g in s})
        self.codes = np.array(sorted(int.from_bytes(g.encode("latin-1"), "big") for g in grams), dtype=np.uint32)
        self.number = {g: int(np.searchsorted(self.codes, int.from_bytes(g.encode("latin-1"), "big"))) for g in grams}
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[self._short(*((self.codes >> s & 255).astype(np.uint16) for s in (16, 8, 0)))] = True

    @staticmethod
    def _short(a, b, c):
        with np.errstate(over="ignore"):
            return a * np.uint16(0x2F35) ^ b * np.uint16(0x1003) ^ c * np.uint16(0x0D41)

    def index(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Matrix of trigrams by rows."""
        found = np.zeros((len(self.codes), len(at) - 1), dtype=bool)
        if len(data) < 3 or not len(self.codes):
            return found
        low = _FOLD[data].astype(np.uint16)
        hits = np.flatnonzero(self.seen[self._short(low[:-2], low[1:-1], low[2:])])
        wide = low[hits].astype(np.uint32) << 16 | low[hits + 1].astype(np.uint32) << 8 | low[hits + 2]
        gram = np.minimum(np.searchsorted(self.codes, wide), len(self.codes) - 1)
        row = np.searchsorted(at, hits, side="right") - 1
        good = (self.codes[gram] == wide) & (hits + 3 <= at[row + 1])
        found[gram[good], row[good]] = True
        return found

    def rows(self, found: np.ndarray, query: Query) -> np.ndarray:
        """Rows that may match: intersections of postings, united over the options of a clause."""
        out = np.ones(found.shape[1], dtype=bool)
        for clause in query:
            any_of = np.zeros(found.shape[1], dtype=bool)
            for grams in clause:
                any_of |= found[[self.number[g] for g in grams]].all(axis=0)
            out &= any_of
        return out
