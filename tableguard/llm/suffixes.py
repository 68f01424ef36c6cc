"""Exact duplicate passages by suffix arrays over shards of candidate strings.

A byte is removed if it is covered by a ``WINDOW``-byte string that also starts anywhere else.

Every window is assigned to the smallest hash of its ``GRAM``-byte substrings; equal windows have
equal keys, so all occurrences of a window meet under one key. Neighbouring windows with one key
form a run, about one per 85 bytes. First only keys and hashes of runs are shuffled:

* a key with one occurrence in the whole corpus cannot hold a repeated window;
* where all runs of a key have the same content, every window in them is repeated;
* the runs of the other keys, one of each content, are fetched and compared.

Comparing: the runs of a task's keys are laid out in shards of bounded bytes, each becomes a
suffix array (Larsson-Sadakane refinement), and a window is repeated if the common prefix with a
neighbour in the array (Kasai) is a window long. The runs of a key that do not fit one shard are
split over several, and the windows of each shard are searched in the suffix array of the others by
bisection. Verdicts go back to all runs of the same content, and from there to the documents.

Texts are bytes in UTF-8; null texts are empty; texts shorter than a window keep everything;
repeated rows are documents of their own, so they remove each other; rows without id are treated
like others; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tableguard.llm.arrays import common_prefixes, prefix_ranges, suffix_array
from tableguard.llm.batches import arrow_schema, column_bytes, id_type, map_arrow, map_batches, mix64, powers, ranges, starts_of
from tableguard.session import cut_lineage

WINDOW, GRAM = 200, 32
#: Windows of the longest run; longer ones are cut.
MOST_WINDOWS = 4096
#: Bytes of strings in a shard.
SHARD_BYTES = 3 << 20
#: Bytes of text handled at a time when keys are computed.
PART_BYTES = 2 << 20


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each substring of ``size`` bytes."""
    n = len(data)
    power, inverse = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        return mix64((total[size:] - total[:-size]) * inverse[: n - size + 1])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row."""
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - size : width - size + n])


def runs_of(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key in ragged texts: row, start in the data, windows, key, twice.

    ``twice`` tells that the key occurs at two places of the run, so it may repeat itself.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    count = np.maximum(np.diff(at) - window + 1, 0)
    if not count.sum():
        return empty
    width = window - gram + 1
    hashes = _gram_hashes(data, gram)
    least = _sliding_least(hashes, width)
    place = ranges(at[:-1], count)
    row = np.repeat(np.arange(len(count)), count)
    key = least[place]
    new_row = np.append(True, row[1:] != row[:-1])
    new = new_row | np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(place)))
    arrived = hashes[place + width - 1] == key
    later = np.add.reduceat(arrived.astype(np.int64), first) - arrived[first]
    # A run that begins as a smaller key arrives has it once; else the first window is counted.
    before = key[np.maximum(first - 1, 0)]
    known = ~new_row[first] & (before > key[first])
    times = np.ones(len(first), np.int64)
    for part in np.array_split(np.flatnonzero(~known), max(1, len(first) // 20_000)):
        times[part] = (hashes[place[first[part]][:, None] + np.arange(width)] == key[first[part]][:, None]).sum(axis=1)
    twice = times + later > 1
    pieces = -(-length // MOST_WINDOWS)
    step = ranges(np.zeros(len(first), np.int64), pieces) * MOST_WINDOWS
    start = np.repeat(place[first], pieces) + step
    size = np.minimum(np.repeat(length, pieces) - step, MOST_WINDOWS)
    return np.repeat(row[first], pieces), start, size, np.repeat(key[first], pieces).view(np.int64), np.repeat(twice, pieces)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, hash of the text (rows with both equal are equal) and text."""
    return docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))


def _runs(named: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of all texts: key, hash of their content, document, start, windows, twice."""
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("content", T.LongType()), T.StructField("_id", id_type(named, "_id")), T.StructField("_hash", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("windows", T.IntegerType()), T.StructField("twice", T.BooleanType()),
    ])

    def part(batch: pa.RecordBatch) -> dict | None:
        from xxhash import xxh3_64_intdigest

        data, at = column_bytes(batch.column("_text"))
        row, start, size, key, twice = runs_of(data, at, window, gram)
        if not len(row):
            return None
        raw = data.tobytes()
        content = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + size + window - 1).tolist(), strict=True)), np.uint64, len(start))
        rows = pa.array(row)
        return {
            "key": key, "content": content.view(np.int64), "_id": batch.column("_id").take(rows), "_hash": batch.column("_hash").take(rows),
            "start": start - at[row], "windows": size.astype(np.int32), "twice": twice,
        }

    return map_batches(named, part, schema, "_text", PART_BYTES)


def _lay_out(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings in one text, each with an end of its own; starts of the strings, starts of windows."""
    at = starts_of(np.array([len(s) + 1 for s in strings], np.int64))
    text = np.empty(at[-1], np.int32)
    body = np.ones(at[-1], bool)
    body[at[1:] - 1] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8)
    text[at[1:] - 1] = 256 + np.arange(len(strings))
    return text, at, ranges(at[:-1], np.diff(at) - window)


def repeated_in(strings: list[bytes], window: int) -> np.ndarray:
    """Which windows of the strings, in order, occur twice in them."""
    text, at, places = _lay_out(strings, window)
    sa, _ = suffix_array(text, int(np.diff(at).max()) + 1)
    shared = common_prefixes(text, sa) >= window
    found = np.zeros(len(text), bool)
    found[sa] = shared | np.append(shared[1:], False)
    return found[places]


def repeated_across(strings: list[bytes], others: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the strings occur in the others, and which of the others' in the strings."""
    text, at, places = _lay_out(strings, window)
    other, _, wanted = _lay_out(others, window)
    sa, _ = suffix_array(text, window)
    low, high = prefix_ranges(text, sa, other, wanted, np.full(len(wanted), window))
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, low[high > low], 1)
    np.add.at(edge, high[high > low], -1)
    found = np.zeros(len(text), bool)
    found[sa] = np.cumsum(edge[:-1]) > 0
    return found[places], high > low


_STRINGS = T.StructType([T.StructField("key", T.LongType()), T.StructField("content", T.LongType()), T.StructField("shards", T.IntegerType()), T.StructField("string", T.BinaryType())])
_FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("content", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("found", T.IntegerType())])


def _stretches(strings: list[tuple[int, int, bytes]], repeated: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Runs of repeated windows of each string: key, content, offset, windows."""
    out = []
    at = starts_of(np.array([len(s) - window + 1 for *_, s in strings], np.int64))
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    cut = np.zeros(len(repeated) + 1, bool)
    cut[at] = True
    inside = repeated[:-1] & repeated[1:] & cut[1:-1]
    starts = np.flatnonzero((edge == 1) | np.concatenate([[False], inside, [False]]))
    ends = np.flatnonzero((edge == -1) | np.concatenate([[False], inside, [False]]))
    owner = np.searchsorted(at, starts, side="right") - 1
    for o, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
        out.append((strings[o][0], strings[o][1], a - int(at[o]), b - a))
    return out


def _compared(strings: DataFrame, window: int) -> DataFrame:
    """Stretches of repeated windows in strings(key, content, shards, string).

    A key of one shard is dealt by key. One of several is dealt to a cell for each pair of shards.
    """
    own = F.pmod(F.col("content"), F.col("shards").cast("long")).cast("int")
    others = F.sequence(F.lit(0), F.col("shards") - 1)
    dealt = (
        strings.withColumn("own", own).withColumn("other", F.explode(others))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "own", "content")
        .select("key", "content", "low", "high", "own", "string")
    )
    arrow = arrow_schema(_FOUND)

    def emit(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, size = None, [], 0  # of the current cell
        ready: list[tuple[int, int, bytes]] = []  # of whole cells of one shard
        ready_size = 0
        for key, content, low, high, own, string in _stream(batches):
            if (key, low, high) != cell:
                if held and cell[1] == cell[2]:
                    if ready_size + size > SHARD_BYTES and ready:
                        yield emit(_stretches(ready, repeated_in([s for *_, s in ready], window), window))
                        ready, ready_size = [], 0
                    ready += [h[1:] for h in held]
                    ready_size += size
                elif held:
                    yield emit(_cell(held, cell[1], window))
                cell, held, size = (key, low, high), [], 0
            held.append((own, key, content, string))
            size += len(string)
        if held and cell[1] != cell[2]:
            yield emit(_cell(held, cell[1], window))
        elif held:
            ready += [h[1:] for h in held]
        if ready:
            yield emit(_stretches(ready, repeated_in([s for *_, s in ready], window), window))

    return map_arrow(dealt, run, _FOUND)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _cell(held: list[tuple[int, int, int, bytes]], low: int, window: int) -> list[tuple[int, int, int, int]]:
    """Windows that two shards of one key share."""
    sides = [[h[1:] for h in held if (h[0] == low) == first] for first in (True, False)]
    if not all(sides):
        return []
    found = repeated_across([s for *_, s in sides[0]], [s for *_, s in sides[1]], window)
    return [x for side, f in zip(sides, found, strict=True) for x in _stretches(side, f, window)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``_id``, ``_hash`` of the text and ``spans`` (first byte, windows) where windows are repeated."""
    named = _named(docs, id_col, text_col)
    runs = _runs(named, window, gram)
    keys = (
        runs.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min("content").alias("least"), F.max("content").alias("most"))
        .where((F.col("n") > 1) | F.col("twice")).select("key", ((F.col("least") != F.col("most")) | F.col("twice")).alias("mixed"))
    )
    kept = cut_lineage(runs.drop("twice").join(keys, "key"))
    whole = kept.where("not mixed").select("_id", "_hash", "start", "windows")
    mixed = kept.where("mixed")
    # One place of each content; the others get its verdict.
    contents = mixed.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_hash", "start", "windows")).alias("at"))
    sizes = contents.groupBy("key").agg(F.sum(F.col("at.windows") + window).alias("bytes")).select("key", F.ceil(F.col("bytes") / SHARD_BYTES).cast("int").alias("shards"))
    wanted = (
        contents.join(sizes, "key").groupBy(F.col("at._id").alias("_id"), F.col("at._hash").alias("_hash"))
        .agg(F.collect_list(F.struct("key", "content", "shards", F.col("at.start").alias("start"), F.col("at.windows").alias("windows"))).alias("wanted"))
    )
    strings = _fetched(named, wanted, window)
    found = _compared(strings, window)
    # Contents that occur more than once are repeated as a whole, whatever the comparison says.
    twice = contents.where("n > 1").select("key", "content", F.lit(0).alias("offset"), F.col("at.windows").alias("found"))
    verdicts = found.unionByName(twice)
    parts = mixed.select("key", "content", "_id", "_hash", "start").join(verdicts, ["key", "content"])
    spans = whole.unionByName(parts.select("_id", "_hash", (F.col("start") + F.col("offset")).alias("start"), F.col("found").alias("windows")))
    # Rows that are equal in id and text give equal spans; each counts once.
    return spans.groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))


def _same_row(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_hash"] == b["_hash"])


def _fetched(named: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The strings of the wanted places; of equal rows the content comes once or more."""
    schema = _STRINGS
    arrow = arrow_schema(schema)
    joined = named.join(wanted, _same_row(named, wanted)).select(named["_text"], wanted["wanted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column("_text").cast(pa.binary()), batch.column("wanted").to_pylist(), strict=True):
                raw = text.as_py()
                columns = ([p["key"] for p in places], [p["content"] for p in places], [p["shards"] for p in places], [raw[p["start"] : p["start"] + p["windows"] + window - 1] for p in places])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    # Rows that are equal in id and text would give a string twice.
    return map_arrow(joined, run, schema).dropDuplicates(["key", "content"])


def _union(spans: list[dict], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Removed byte runs: starts and ends."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.array([s["start"] for s in spans], np.int64)
    order = np.argsort(starts, kind="stable")
    ends = np.maximum.accumulate((starts + np.array([s["windows"] for s in spans], np.int64) + window - 1)[order])
    starts = starts[order]
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' text of every document.

    Kept bytes may cut a character; ``kept`` is therefore binary.
    """
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()),
    ])
    return _finished(docs, id_col, text_col, window, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """What ``remove_repeats`` gives, without the kept bytes."""
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ])
    return _finished(docs, id_col, text_col, window, schema)


def _finished(docs: DataFrame, id_col: str, text_col: str, window: int, schema: T.StructType) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col, window)
    named = _named(docs, id_col, text_col)
    joined = named.join(spans, _same_row(named, spans), "left").select(named["_id"], named["_text"], spans["spans"])

    def part(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
        for text, found in zip(batch.column("_text").cast(pa.binary()), batch.column("spans").to_pylist(), strict=True):
            raw = text.as_py()
            starts, ends = _union(found or [], window)
            edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            values = (len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept)
            for column, value in zip(out.values(), values, strict=False):
                column.append(value)
        return {id_col: batch.column("_id")} | out

    return map_batches(joined, part, schema, "_text")
