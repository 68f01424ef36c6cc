"""Runs in texts: maximal stretches of words that repeat with a period, found by recompression.

The words of a slice of texts are numbered and laid out in one sequence, with a mark of its own
between texts. Recompression shortens that sequence by turns: blocks of one symbol become a symbol,
then pairs of a left and a right symbol do, where the sides are chosen by a hash of the symbol. The
levels are the derivation tree of a run-length grammar, and equal stretches have equal symbols in
them, but for a symbol or two at their ends. So how far two places agree is told by climbing while
the symbols above agree and coming down where they differ, a few symbols a level (``Grammar.reach``).

A run of period q holds at least three multiples of q, at which the same word stands. These grids
(1 + 1/2 + 1/3 + .. of the words) give the candidates; the grammar extends them exactly to both
sides. A stretch that has several periods is told by the smallest one, of which the others are
multiples, as a run is at least three periods long.

Null and empty texts, and texts of fewer words than a run needs, have no runs; a text without white
space is one word. Texts are compared with themselves only, so repeated rows and ids give repeated
results. A text longer than a slice is a slice of its own: about 30 bytes of memory for each of its
bytes. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tableguard.llm.batches import column_bytes, doc_columns, id_type, map_arrow, map_batches, mix64, slices, starts_of

#: A run has at least this many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Symbols a text may have left at the highest level; there they are compared one by one.
SHORT = 8
#: Candidates that are extended together at least, unless the periods are through.
TOGETHER = 64
#: Words joined at a time when kept words are written.
JOINED = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """Words of some texts: a number each, bytes of each, and the first word of each text."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    data: np.ndarray


def words_of(column: pa.Array) -> Words:
    data, at = column_bytes(column)
    space = _SPACE[data]
    inside = ~space
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    filled = at[:-1] < at[1:]
    first[at[:-1][filled]] = inside[at[:-1][filled]]
    last[at[1:][filled] - 1] = inside[at[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(starts_of(ends - starts)), pa.py_buffer(data[inside])])
    codes = packed.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return Words(codes, starts, ends, np.searchsorted(starts, at), data)


class Grammar:
    """Run-length grammar of a sequence, as the levels of its derivation tree.

    ``up[l][u]`` is the symbol of level l + 1 that derives symbol u of level l, and ``down[l][p]``
    the first symbol of level l that symbol p of level l + 1 derives.
    """

    def __init__(self, sequence: np.ndarray, marks: int) -> None:
        """``marks``: symbols from this one on stand once each, part texts and are never merged."""
        self.symbols, self.up, self.down, self.blocks = [sequence], [], [], []
        self.low, self.high = marks, int(sequence.max(initial=0)) + 1
        self.named = self.high
        turn = 0
        while self._longest() > SHORT:
            self._merge_blocks()
            turn += 1
            self._merge_pairs(turn)

    def _is_mark(self, s: np.ndarray) -> np.ndarray:
        return (s >= self.low) & (s < self.high)

    def _longest(self) -> int:
        return int(np.diff(np.flatnonzero(self._is_mark(self.symbols[-1]))).max(initial=1)) - 1

    def _name(self, keys: np.ndarray) -> np.ndarray:
        """New symbols, the same for equal keys."""
        found, names = np.unique(keys, return_inverse=True)
        names = names + self.named
        self.named += len(found)
        return names

    def _add(self, starts: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        n = len(self.symbols[-1])
        heads = np.zeros(n, np.int32)
        heads[starts[1:]] = 1
        self.up.append(np.cumsum(heads, dtype=np.int32))
        self.down.append(np.append(starts, n).astype(np.int32))
        self.symbols.append(symbols)
        self.blocks.append(blocks)

    def _merge_blocks(self) -> None:
        s = self.symbols[-1]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) == len(s):
            return
        sizes = np.diff(np.append(starts, len(s)))
        symbols = s[starts].astype(np.int64)
        several = np.flatnonzero(sizes > 1)
        symbols[several] = self._name(symbols[several] * (len(s) + 1) + sizes[several])
        self._add(starts, symbols, True)

    def _merge_pairs(self, turn: int) -> None:
        """Of eight ways to part the symbols in left and right ones, the one that merges most."""
        s = self.symbols[-1].astype(np.int64)
        hashed = mix64(s.astype(np.uint64) + np.uint64(turn << 40)).astype(np.uint8)
        free = ~self._is_mark(s)
        free = free[:-1] & free[1:]
        best = np.zeros(0, np.int64)
        for bit in range(4):
            side = hashed >> bit & 1
            for left in (side, side ^ 1):
                heads = np.flatnonzero((left[:-1] > left[1:]) & free)
                best = max(best, heads, key=len)
        if not len(best):
            return
        starts = np.ones(len(s), bool)
        starts[best + 1] = False
        starts = np.flatnonzero(starts)
        symbols = s[starts]
        symbols[np.searchsorted(starts, best)] = self._name(s[best] * self.named + s[best + 1])
        self._add(starts, symbols, False)

    def _steps(self, level: int, u: np.ndarray, v: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols that equal u and v can be passed by at once, and whether each stands at the
        near end of the symbol above it."""
        up, down = self.up[level], self.down[level]
        left = []
        near = []
        for x in (u, v):
            lo, hi = down[up[x]], down[up[x] + 1]
            left.append(hi - x if sign > 0 else x - lo + 1)
            near.append(x == lo if sign > 0 else x == hi - 1)
        size = np.minimum(*left) if self.blocks[level] else np.ones(len(u), np.int32)
        return size, near[0], near[1]

    def reach(self, i: np.ndarray, j: np.ndarray, sign: int) -> np.ndarray:
        """Number of symbols that agree from places i and j on (sign 1) or back (sign -1); i < j."""
        u, v = i.astype(np.int64), j.astype(np.int64)
        top = len(self.up)
        stuck = np.full(len(u), top)
        live = np.arange(len(u))
        for level in range(top):
            s, above, up = self.symbols[level], self.symbols[level + 1], self.up[level]
            climbing = []
            while len(live):
                same = s[u[live]] == s[v[live]]
                stuck[live[~same]] = level
                live = live[same]
                if not len(live):
                    break
                a, b = u[live], v[live]
                size, near_a, near_b = self._steps(level, a, b, sign)
                climbs = near_a & near_b & (above[up[a]] == above[up[b]])
                climbing.append(live[climbs])
                live, size = live[~climbs], size[~climbs]
                u[live] += sign * size
                v[live] += sign * size
            live = np.concatenate(climbing) if climbing else live
            u[live], v[live] = up[u[live]], up[v[live]]
        s = self.symbols[top]
        while len(live):
            live = live[s[u[live]] == s[v[live]]]
            u[live] += sign
            v[live] += sign
        for level in range(top - 1, -1, -1):
            s, down = self.symbols[level], self.down[level]
            live = np.flatnonzero(stuck > level)
            for x in (u, v):
                x[live] = down[x[live]] if sign > 0 else down[x[live] + 1] - 1
            while len(live := live[s[u[live]] == s[v[live]]]):
                size, _, _ = self._steps(level, u[live], v[live], sign)
                u[live] += sign * size
                v[live] += sign * size
        return np.abs(u - i)


class _Finder:
    """Runs of one sequence, by growing period."""

    def __init__(self, sequence: np.ndarray, marks: int, rows: np.ndarray, least: int, times: int) -> None:
        """``rows``: places of the marks."""
        self.sequence, self.rows, self.least, self.times = sequence, rows, least, times
        self.marks = marks
        self.grammar: Grammar | None = None
        self.covering = np.full(len(sequence), -1, np.int32)  # a known run at each place
        self.start, self.end, self.period = (np.zeros(0, np.int64) for _ in range(3))
        self.known: dict[tuple[int, int], int] = {}

    def find(self) -> None:
        longest = int(np.diff(self.rows).max(initial=0)) - 1
        waiting: list[tuple[np.ndarray, int]] = []
        band = 1
        for q in range(1, longest // self.times + 1):
            if q >= 2 * band:
                band = q
                if sum(len(p) for p, _ in waiting) >= TOGETHER:
                    self._extend(waiting)
                    waiting = []
            places = self._uncovered(self._candidates(q), q)
            if len(places):
                waiting.append((places, q))
                if len(places) > TOGETHER * 64:
                    self._extend(waiting)
                    waiting = []
        self._extend(waiting)

    def _candidates(self, q: int) -> np.ndarray:
        """Multiples of q from which on the same word stands at as many multiples as a run holds."""
        grid = self.sequence[::q]
        equal = grid[1:] == grid[:-1]
        pairs = max(self.times, self.least // q) - 1
        if len(equal) < pairs:
            return np.zeros(0, np.int64)
        streak, left = equal, pairs
        whole = streak
        width = 1  # ``whole`` tells of ``width`` pairs from each place on
        while width < left:
            more = min(width, left - width)
            whole = whole[: len(whole) - more] & whole[more:]
            width += more
        places = np.flatnonzero(whole) * q
        if not len(places):
            return places
        row = np.searchsorted(self.rows, places, side="right")
        return places[places + pairs * q < self.rows[np.minimum(row, len(self.rows) - 1)]]

    def _uncovered(self, places: np.ndarray, q) -> np.ndarray:
        """Places whose pair does not lie in a known run of a period that divides q."""
        if not len(places) or not len(self.start):
            return places
        return places[self._open(places, q)]

    def _open(self, places: np.ndarray, q) -> np.ndarray:
        run = self.covering[places]
        inside = (run >= 0) & (np.asarray(q) % self.period[run] == 0) & (places + q < self.end[run])
        return ~inside

    def _extend(self, waiting: list[tuple[np.ndarray, int]]) -> None:
        if not waiting:
            return
        places = np.concatenate([p for p, _ in waiting])
        q = np.repeat([n for _, n in waiting], [len(p) for p, _ in waiting])
        leads = np.ones(len(places), bool)  # the first of neighbouring candidates
        leads[1:] = (q[1:] != q[:-1]) | (places[1:] != places[:-1] + q[1:])
        self._measure(places[leads], q[leads])
        rest = ~leads
        places, q = places[rest], q[rest]
        if len(places) and len(self.start):
            rest = self._open(places, q)
            places, q = places[rest], q[rest]
        for at in range(0, len(places), 1 << 18):
            self._measure(places[at : at + (1 << 18)], q[at : at + (1 << 18)])

    def _measure(self, places: np.ndarray, q: np.ndarray) -> None:
        if not len(places):
            return
        if self.grammar is None:
            self.grammar = Grammar(self.sequence, self.marks)
        ends = places + q + self.grammar.reach(places, places + q, 1)
        starts = places - self.grammar.reach(places - 1, places + q - 1, -1)
        long_ = ends - starts >= np.maximum(self.least, self.times * q)
        found = sorted(set(zip(q[long_].tolist(), starts[long_].tolist(), ends[long_].tolist())), reverse=True)
        fresh: dict[tuple[int, int], int] = {}
        for n, s, e in found:  # the smallest period of a stretch comes last
            if (s, e) in self.known:
                self.period[self.known[s, e]] = min(n, self.period[self.known[s, e]])
            else:
                fresh[s, e] = n
        if fresh:
            for s, e in fresh:
                self.known[s, e] = len(self.known)
                self.covering[s:e] = self.known[s, e]
            s, e = np.array(list(fresh), np.int64).T
            self.start, self.end, self.period = np.append(self.start, s), np.append(self.end, e), np.append(self.period, list(fresh.values()))


@dataclass
class Runs:
    """Runs of some texts by text, start and period; ``first`` is the first run of each text."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray
    first: np.ndarray


def runs_of(words: Words, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> Runs:
    """All runs of at least ``least`` words and ``times`` periods (3 or more)."""
    if times < 3:
        raise ValueError("a run has at least three periods")
    counts = np.diff(words.rows)
    long_ = np.flatnonzero(counts >= max(least, times))
    sizes = counts[long_]
    marks_at = starts_of(sizes + 1)  # a mark before each text, and one behind the last
    lowest = int(words.codes.max(initial=-1)) + 1
    sequence = np.empty(int(marks_at[-1]) + 1, np.int64 if lowest + len(long_) > 2**31 - 2 else np.int32)
    sequence[marks_at] = lowest + np.arange(len(marks_at))
    is_word = np.ones(len(sequence), bool)
    is_word[marks_at] = False
    chosen = np.repeat(counts >= max(least, times), counts)
    sequence[is_word] = words.codes[chosen]
    finder = _Finder(sequence, lowest, marks_at, least, times)
    if len(long_):
        finder.find()
    held = np.searchsorted(marks_at, finder.start, side="right") - 1
    order = np.lexsort((finder.period, finder.start, held))
    held, start, end, period = held[order], finder.start[order], finder.end[order], finder.period[order]
    row = long_[held] if len(held) else held
    return Runs(start - marks_at[held] - 1, end - start, period, np.searchsorted(row, np.arange(len(counts) + 1)))


def kept_stretches(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of the n words that are left when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:n]) == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], kept.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def joined(words: Words, row: int, stretches: list[tuple[int, int]]) -> Iterator[bytes]:
    """Bytes of the stretches' words with one space between words, in pieces."""
    base, space = int(words.rows[row]), b""
    for lo, hi in stretches:
        for at in range(lo, hi, JOINED):
            last = min(at + JOINED, hi)
            piece = words.data[words.starts[base + at] : words.ends[base + last - 1]].tobytes()
            yield space + b" ".join(piece.split())
            space = b" "


def _rows(column: pa.Array, least: int, times: int) -> Iterator[tuple[Words, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    words = words_of(column)
    runs = runs_of(words, least, times)
    for row in range(len(column)):
        at = slice(int(runs.first[row]), int(runs.first[row + 1]))
        yield words, row, int(words.rows[row + 1] - words.rows[row]), runs.start[at], runs.length[at], runs.period[at]


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: id, start (word number), length and period in words."""
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), *(T.StructField(n, T.LongType()) for n in ("start", "length", "period"))])

    def part(batch: pa.RecordBatch) -> dict:
        runs = runs_of(words_of(batch.column("_text")), least, times)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(runs.first))
        return {id_col: batch.column("_id").take(pa.array(owner)), "start": runs.start, "length": runs.length, "period": runs.period}

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")


def collapse(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS, text_col: str = "text") -> DataFrame:
    """The rows with each run of a text cut to its first period. Texts without a run stay as they
    are, white space included; others become their kept words with one space between."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                column = part.column(text_col)
                texts = column.to_pylist()
                for words, row, n, start, length, period in _rows(column, least, times):
                    if len(start):
                        texts[row] = b"".join(joined(words, row, kept_stretches(n, start, length, period))).decode()
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return map_arrow(docs, run, schema)


def _best(length: np.ndarray, period: np.ndarray) -> int:
    """The run of the greatest length / period; the earlier one of equals."""
    best = 0
    lengths, periods = length.tolist(), period.tolist()
    for k in range(1, len(lengths)):
        if lengths[k] * periods[best] > lengths[best] * periods[k]:
            best = k
    return best


def digest(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, number of runs, the run of most periods (ties: smallest start, then period) and digests
    of all runs and of the collapsed text."""
    numbers = ("start", "length", "period", "exponent_milli")
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_runs", T.LongType()), *(T.StructField(n, T.LongType()) for n in numbers),
        T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
    ])

    def part(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
        for words, row, n, start, length, period in _rows(batch.column("_text"), least, times):
            shown: list[int | None] = [None] * 4
            if len(start):
                k = _best(length, period)
                shown = [int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k])]
            out["n_runs"].append(len(start))
            for name, value in zip(numbers, shown):
                out[name].append(value)
            lines = "".join(f"{s},{m},{p}\n" for s, m, p in zip(start.tolist(), length.tolist(), period.tolist()))
            out["runs_sha256"].append(hashlib.sha256(lines.encode()).hexdigest())
            left = hashlib.sha256()
            for piece in joined(words, row, kept_stretches(n, start, length, period) if len(start) else [(0, n)]):
                left.update(piece)
            out["collapsed_sha256"].append(left.hexdigest())
        return {id_col: batch.column("_id"), **out}

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where a tenth of the texts, told by the CRC-32 of the id, repeat some words from
    a place on, to have runs of known kind. Rows without id are left as they are."""
    kind = id_type(docs, id_col)
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(text_col, T.StringType())])

    def part(batch: pa.RecordBatch) -> dict:
        texts = batch.column("_text")
        ids = batch.column("_id").to_pylist()
        hit = [i for i, x in enumerate(ids) if x is not None and zlib.crc32(str(x).encode()) % 10 == 0]
        if hit:
            texts = texts.to_pylist()
            for i in hit:
                texts[i] = repeated(texts[i], zlib.crc32(str(ids[i]).encode()) // 10)
        return {id_col: batch.column("_id"), text_col: texts}

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")


def repeated(text: str | None, g: int) -> str | None:
    """The text's words with one space between, repeating from word g % n on."""
    words = (text or "").encode().split()
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
