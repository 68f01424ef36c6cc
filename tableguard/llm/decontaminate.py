"""Benchmark decontamination by suffix arrays over the training texts.

The benchmark's windows (runs of 13 words; a shorter item is one window) go to every task in
chunks of bounded size. Each part of a batch of documents is a shard: its words are numbered by the
benchmark's vocabulary, the stretches in which a window could lie become a suffix array, and the
benchmark's suffixes are binary-searched in it, all at once. The ranges found give every verbatim
match and its place. Nothing is shuffled; a larger benchmark means more passes over the texts.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, told apart by a 64-bit hash.
Null texts have no words; items without words match nothing; items with equal ids count as one;
repeated rows give repeated results; a document without words is clean; other columns are not read
by ``measure`` and pass through ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from tableguard.llm.arrays import prefix_ranges, suffix_array
from tableguard.llm.batches import arrow_schema, column_bytes, id_type, map_arrow, mix64, powers, ranges, slices, starts_of

WINDOW = 13
#: Bytes of benchmark text that one pass takes to every task.
CHUNK_BYTES = 4 << 20
#: Bytes of documents that form a shard.
SHARD_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])[_LOWER]

def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ragged texts, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = powers(len(data))
    with np.errstate(over="ignore"):
        total = np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)])
        before = np.where(begin > 0, total[np.maximum(begin, 1) - 1], np.uint64(0))
        words = mix64((total[end] - before) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(begin, at)


@dataclass(frozen=True)
class Index:
    """Windows of a chunk of the benchmark: numbered words, distinct windows, their items."""

    vocabulary: np.ndarray  # sorted hashes; a word's number is its place plus 1
    short: np.ndarray  # by 16 bits of a hash whether a word has them
    least: np.ndarray  # by word, length of the shortest window it begins
    most: np.ndarray  # by word, length of the longest
    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray  # by window, offsets into items
    items: list[str]  # ids as text, by window

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> "Index":
        data, at = column_bytes(pa.array(texts, pa.large_string()))
        words, word_at = words_of(data, at)
        vocabulary, tokens = np.unique(words, return_inverse=True)
        tokens = tokens.astype(np.int64) + 1
        count = np.diff(word_at)
        lengths = np.minimum(count, WINDOW)
        n = np.where(count > 0, count - lengths + 1, 0)
        starts, lengths, owner = ranges(word_at[:-1], n), np.repeat(lengths, n), np.repeat(np.arange(len(count)), n)
        groups: dict[bytes, list[int]] = {}
        for k, (s, m) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            groups.setdefault(tokens[s : s + m].tobytes(), []).append(k)
        chosen = np.array([g[0] for g in groups.values()], dtype=np.int64)
        items = [sorted({int(owner[k]) for k in g}) for g in groups.values()]
        starts, lengths = starts[chosen], lengths[chosen]
        least, most = np.full(len(vocabulary) + 1, 1 << 30), np.zeros(len(vocabulary) + 1, np.int64)
        np.minimum.at(least, tokens[starts], lengths)
        np.maximum.at(most, tokens[starts], lengths)
        short = np.zeros(1 << 16, bool)
        short[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        return Index(vocabulary, short, least, most, tokens, starts, lengths, starts_of(np.array([len(x) for x in items], np.int64)), [str(ids[o]) for x in items for o in x])

    def number(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words; 0 if the benchmark does not have them."""
        out = np.zeros(len(words), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.short[(words >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[place] == words[maybe], place + 1, 0)
        return out

    def matches(self, words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence of a window in a shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = self.number(words)
        n = len(number)
        if not n:
            return none
        # How many words of the benchmark stand in a row from here on, inside one document.
        stop = np.full(n + 1, n, np.int64)
        stop[:-1][number == 0] = np.flatnonzero(number == 0)
        inner = word_at[1:-1][word_at[1:-1] < n]
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        document_end = np.repeat(word_at[1:], np.diff(word_at))
        run = np.minimum(stop[:-1], document_end) - np.arange(n)
        candidates = np.flatnonzero(run >= self.least[number])
        if not len(candidates):
            return none
        # The stretches that windows can cover, with a 0 after each.
        need = np.minimum(self.most[number[candidates]], run[candidates])
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, candidates, 1)
        np.add.at(edge, candidates + need, -1)
        places = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        new = np.zeros(n + 1, bool)
        new[inner] = True
        gap = np.append(False, (places[1:] != places[:-1] + 1) | new[places[1:]])
        at = np.arange(len(places)) + np.cumsum(gap)
        text = np.zeros(at[-1] + 2, np.int64)
        text[at] = number[places]
        back = np.zeros(len(text), np.int64)
        back[at] = places
        # Windows all of whose words are there.
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[text] = True
        windows = np.arange(len(self.starts))
        for k in range(WINDOW):
            longer = self.lengths[windows] > k
            there = present[self.tokens[np.where(longer, self.starts[windows] + k, 0)]]
            windows = windows[there | ~longer]
        if not len(windows):
            return none
        sa, _ = suffix_array(text, WINDOW)
        low, high = prefix_ranges(text, sa, self.tokens, self.starts[windows], self.lengths[windows])
        return np.repeat(windows, high - low), back[sa[ranges(low, high - low)]]

    def items_of(self, windows: np.ndarray) -> set[str]:
        return {self.items[k] for w in windows.tolist() for k in range(self.item_at[w], self.item_at[w + 1])}


def indexes(benchmark: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Index]:
    """Indexes of chunks of the benchmark, one after the other."""
    ids: list = []
    texts: list = []
    size = 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= chunk_bytes:
            yield Index.of(ids, texts)
            ids, texts, size = [], [], 0
    yield Index.of(ids, texts)


_STATE = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


#: Makes the output of a part from its rows and their matches.
Finish = Callable[[pa.RecordBatch, list[dict | None]], pa.RecordBatch]


def _searched(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, schema: T.StructType, finish: Finish, chunk_bytes: int) -> DataFrame:
    """``finish`` applied to all rows and what the benchmark covers in them.

    A benchmark of one chunk takes one pass. Before the last of several, matches go along in a column.
    """
    context = docs.sparkSession.sparkContext
    out = "_matched"
    while out in docs.columns:
        out += "_"
    waiting: Index | None = None
    for index in indexes(benchmark, item_col, item_text_col, chunk_bytes):
        if waiting is not None:
            if out not in docs.columns:
                docs = docs.withColumn(out, F.lit(None).cast(_STATE))
            docs = _pass(docs, context.broadcast(waiting), text_col, out, docs.schema, _carry)
        waiting = index
    return _pass(docs, context.broadcast(waiting), text_col, out, schema, finish)


def _pass(docs: DataFrame, index: Broadcast, text_col: str, out: str, schema: T.StructType, finish: Finish) -> DataFrame:
    text_place = docs.columns.index(text_col)
    carried = out in docs.columns
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_place, SHARD_BYTES):
                old = part.column(part.num_columns - 1).to_pylist() if carried else [None] * part.num_rows
                state = _extend(index.value, part.column(text_place), old)
                done = finish(part.select(range(part.num_columns - carried)), state)
                yield pa.RecordBatch.from_arrays(done.columns, schema=arrow)

    return map_arrow(docs, run, schema)


def _carry(part: pa.RecordBatch, state: list[dict | None]) -> pa.RecordBatch:
    return _with_state(part, state, "_matched")


def _with_state(part: pa.RecordBatch, state: list[dict | None], out: str) -> pa.RecordBatch:
    kind = arrow_schema(T.StructType([T.StructField(out, _STATE)])).field(0).type
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(state, kind)], [str(k) for k in range(part.num_columns + 1)])


def matched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "matched", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All rows and columns, and in ``out`` the stretches of words that benchmark items cover.

    ``out`` holds starts and ends (words from 0, end exclusive, longest stretches) and the ids of
    the items that occur, as text. It is null where nothing matches.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _STATE)])
    return _searched(docs, benchmark, text_col, item_col, item_text_col, schema, lambda part, state: _with_state(part, state, out), chunk_bytes)


def _extend(index: Index, texts: pa.Array, state: list[dict | None]) -> list[dict | None]:
    words, word_at = words_of(*column_bytes(texts))
    windows, first = index.matches(words, word_at)
    if not len(first):
        return state
    row = np.searchsorted(word_at, first, side="right") - 1
    order = np.lexsort((first, row))
    windows, first, row = windows[order], first[order], row[order]
    ends = first + index.lengths[windows]
    cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=True):
        r = int(row[a])
        old = state[r] or {"starts": [], "ends": [], "items": []}
        s, e = _union(np.append(old["starts"], first[a:b] - word_at[r]).astype(np.int64), np.append(old["ends"], ends[a:b] - word_at[r]).astype(np.int64))
        items = index.items_of(np.unique(windows[a:b])) | set(old["items"])
        state[r] = {"starts": s.tolist(), "ends": e.tolist(), "items": sorted(items)}
    return state


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; those that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def measure(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document its words, hit words, occurring items and whether it is contaminated."""
    long = T.LongType()
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_words", long), T.StructField("n_hit", long),
        T.StructField("n_items", long), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    ])
    arrow = arrow_schema(schema)

    def finish(part: pa.RecordBatch, state: list[dict | None]) -> pa.RecordBatch:
        counts, hits = word_counts(part.column(1)), hit_words(state)
        items = [x["items"] if x else [] for x in state]
        columns = [part.column(0), counts, hits, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], contaminated(counts, hits)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    narrow = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return _searched(narrow, benchmark, "_text", item_col, item_text_col, schema, finish, CHUNK_BYTES)


def word_counts(texts: pa.Array) -> np.ndarray:
    data, at = column_bytes(texts)
    if not len(data):
        return np.zeros(len(texts), np.int64)
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < len(data)]
    first[cuts] = inside[cuts]
    return np.diff(starts_of(first)[at])


def hit_words(state: list[dict | None]) -> np.ndarray:
    return np.array([sum(x["ends"]) - sum(x["starts"]) if x else 0 for x in state], dtype=np.int64)


def contaminated(words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """At least a twentieth of the words are covered by benchmark windows."""
    return (hits > 0) & (20 * hits >= words)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents that are not contaminated, with their columns."""
    place = docs.columns.index(text_col)

    def finish(part: pa.RecordBatch, state: list[dict | None]) -> pa.RecordBatch:
        return part.filter(pa.array(~contaminated(word_counts(part.column(place)), hit_words(state))))

    return _searched(docs, benchmark, text_col, item_col, item_text_col, docs.schema, finish, CHUNK_BYTES)
