"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has a bit for each bit position that is set in over half of the XXH64 hashes (seed
42) of a text's shingles. Fingerprints that differ in at most ``4`` bits are linked.

Search: the 64 bits are cut into three blocks. Two linked fingerprints differ in at most one bit in
some block (4 // 3). The anchors of a block are the words of a covering code: the Hamming code of
15 bits, in which every word lies within distance 1 of exactly one codeword, times all values of
the 6 or 7 other bits. A fingerprint's home is its nearest anchor; it is replicated to every anchor
within covering radius plus threshold (1 + 1) of it, about 15 per block. So of two fingerprints
that differ in at most one bit of the block, the second one always reaches the first one's home,
where all 64 bits are compared. One code over all 64 bits would need hundreds of replicas or leave
a handful of anchors; in blocks the buckets are small (2^17 anchors and more each).

Equal fingerprints become one first. A bucket gives out the links of a spanning forest, never all
its pairs. A bucket with more than ``BUCKET`` homes is cut into a grid of cells, homes by others,
so that no task gets more than a cell, and every pair still meets in one.

Texts without words have fingerprint zero and are linked like others; null texts count as empty;
repeated rows are repeated in the result; rows without id are fingerprinted and linked, but never
give a component its id; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tableguard.llm.batches import arrow_schema, doc_columns, id_type, map_arrow, map_batches, mix64, ranges, starts_of
from tableguard.llm.components import components
from tableguard.session import cut_lineage

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Bits of the blocks, and how many of them the Hamming code spans.
BLOCKS, CODED = ((0, 21), (21, 21), (42, 22)), 15
#: Bytes of one text handled at a time.
TEXT_BLOCK = 4 << 20
#: Homes of an ordinary bucket; most buckets that may be cut into cells; others of a cell.
BUCKET, MOST_CUT, CELL_OTHERS = 2000, 10_000, 100_000
#: Pairs compared at a time.
PAIRS = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words of a text in blocks; each begins with the last words of the one before."""
    kept: list[bytes] = []
    start = 0
    while start < len(text):
        # A block ends at the first white space after its length.
        gap = _SPACE.search(text, start + TEXT_BLOCK)
        end = gap.start() if gap else len(text)
        words = kept + text[start:end].split()
        yield words
        kept, start = words[max(0, len(words) - size + 1) :], end


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    text = b" ".join(words)
    starts = starts_of(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    count = max(1, len(words) - size + 1)
    ends = (starts[min(size, len(words)) :] - 1)[:count].tolist()
    return np.fromiter((xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends, strict=True)), np.uint64, count)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Fingerprint of a text, as a signed 64-bit number."""
    text = text.lower()  # of bytes: A-Z only
    counts, total = np.zeros(64, np.int64), 0
    short: list[bytes] = []
    for words in _word_blocks(text, size):
        short = words
        if len(words) >= size:
            hashes = _hashes(words, size)
            counts += _bit_counts(hashes)
            total += len(hashes)
    if not total and short:  # fewer words than a shingle has
        counts, total = _bit_counts(_hashes(short, size)), 1
    if not total:
        return 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id and ``fp`` of every text."""
    schema = T.StructType([T.StructField(id_col, id_type(docs, id_col)), T.StructField("fp", T.LongType())])

    def part(batch: pa.RecordBatch) -> dict:
        texts = batch.column("_text").cast(pa.binary())
        return {id_col: batch.column("_id"), "fp": [fingerprint(t.as_py() or b"", size) for t in texts]}

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")


# Anchors ----------------------------------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Syndromes of the Hamming code: the exclusive or of the numbers (from 1) of the set bits."""
    out = np.zeros(len(words), np.int64)
    for bit in range(CODED):
        out ^= np.where(words >> bit & 1, bit + 1, 0)
    return out


def _ball(free: int, radius: int) -> list[np.ndarray]:
    """By syndrome, the changes of at most ``radius`` bits that lead to an anchor."""
    out: list[list[int]] = [[] for _ in range(CODED + 1)]
    for weight in range(radius + 1):
        for bits in combinations(range(CODED + free), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1 if b < CODED else 0
            out[syndrome].append(sum(1 << b for b in bits))
    return [np.array(x, np.int64) for x in out]


def _home(words: np.ndarray) -> np.ndarray:
    syndrome = _syndromes(words)
    return words ^ np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)


def _block(fp: np.ndarray, number: int) -> np.ndarray:
    shift, width = BLOCKS[number]
    return (fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)


def _home_keys(fp: np.ndarray) -> np.ndarray:
    """Key of the home in each block: block number and anchor."""
    return np.concatenate([_home(_block(fp, k)) | k << 24 for k in range(len(BLOCKS))])


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place in ``fp``, whether home) of every anchor the fingerprints go to."""
    keys, places, homes = [], [], []
    for k, (_, width) in enumerate(BLOCKS):
        words = _block(fp, k)
        syndrome, home = _syndromes(words), _home(words)
        for s, changes in enumerate(_ball(width - CODED, 2)):
            at = np.flatnonzero(syndrome == s)
            anchors = words[at][:, None] ^ changes[None, :]
            keys.append((anchors | k << 24).ravel())
            places.append(np.repeat(at, len(changes)))
            homes.append((anchors == home[at][:, None]).ravel())
    return np.concatenate(keys), np.concatenate(places), np.concatenate(homes)


def _cut_buckets(distinct: DataFrame) -> dict[int, tuple[int, int]]:
    """Buckets to cut, with how often by homes and by others.

    Only buckets with many homes, and those that their fingerprints are replicated to, can be
    large. The threshold rises with the number of fingerprints, so at most ``MOST_CUT`` buckets
    come to the driver, whatever the data.
    """
    schema = T.StructType([T.StructField("key", T.LongType())])
    keys = map_batches(distinct.select("fp"), lambda batch: {"key": _home_keys(batch.column("fp").to_numpy())}, schema)
    least = max(BUCKET, len(BLOCKS) * distinct.count() // MOST_CUT)
    homes = {r["key"]: r["count"] for r in keys.groupBy("key").count().where(F.col("count") > least).collect()}
    others: dict[int, int] = {}
    for key, count in homes.items():
        width = BLOCKS[key >> 24][1]
        near = np.concatenate([_ball(width - CODED, 3)[0]])  # anchors around an anchor
        for anchor in (key ^ near).tolist():
            others[anchor] = others.get(anchor, 0) + count
    return {key: (-(-homes.get(key, 1) // BUCKET), -(-count // CELL_OTHERS)) for key, count in others.items()}


_SPREAD = T.StructType([T.StructField("key", T.LongType()), T.StructField("cell", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("fp", T.LongType())])
#: A row takes part as home, as other, or as both.
_HOME, _OTHER, _BOTH = 1, 2, 3


def _spread(distinct: DataFrame, cut: dict[int, tuple[int, int]]) -> DataFrame:
    """A row for each anchor of each fingerprint, and in cut buckets for each of its cells."""
    cut_keys = np.array(sorted(k for k, grid in cut.items() if grid != (1, 1)), np.int64)
    rows, columns = (np.array([cut[k][i] for k in cut_keys.tolist()], np.int64) for i in (0, 1))

    def part(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy()
        key, place, home = replicas(fp)
        kind = np.where(home, _BOTH, _OTHER)
        cell = np.zeros(len(key), np.int64)
        if len(cut_keys):
            at = np.minimum(np.searchsorted(cut_keys, key), len(cut_keys) - 1)
            hot = cut_keys[at] == key
            out = [(key[~hot], cell[~hot], kind[~hot], place[~hot])]
            spread = mix64(fp.view(np.uint64))
            for as_home in (True, False):
                chosen = np.flatnonzero(hot & home) if as_home else np.flatnonzero(hot)
                r, c, p = rows[at[chosen]], columns[at[chosen]], place[chosen]
                n = c if as_home else r
                inner = ranges(np.zeros(len(n), np.int64), n)
                own = (spread[p] % (r if as_home else c).astype(np.uint64)).astype(np.int64)
                cells = np.repeat(own * c, n) + inner if as_home else inner * np.repeat(c, n) + np.repeat(own, n)
                out.append((np.repeat(key[chosen], n), cells, np.full(len(cells), _HOME if as_home else _OTHER), np.repeat(p, n)))
            key, cell, kind, place = (np.concatenate(x) for x in zip(*out, strict=True))
        return {"key": key, "cell": cell.astype(np.int32), "kind": kind.astype(np.int32), "fp": fp[place]}

    return map_batches(distinct.select("fp"), part, _SPREAD)


# Comparing --------------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the smallest one of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(label[a], label[b]):
            keep = label != np.arange(len(nodes))
            return nodes[keep], nodes[label[keep]]


def links_of(group: np.ndarray, kind: np.ndarray, fp: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and others of the same group (numbers in ascending order)."""
    homes, others = np.flatnonzero(kind & _HOME), np.flatnonzero(kind & _OTHER)
    first = np.searchsorted(group[homes], group[others], side="left")
    count = np.searchsorted(group[homes], group[others], side="right") - first
    others, first, count = others[count > 0], first[count > 0], count[count > 0]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total, start = starts_of(count), 0
    bits = fp.view(np.uint64)
    while start < len(others):
        end = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS, side="right")) - 1)
        x = np.repeat(bits[others[start:end]], count[start:end])
        y = bits[homes[ranges(first[start:end], count[start:end])]]
        near = np.flatnonzero(np.bitwise_count(x ^ y) <= most)
        near = near[x[near] != y[near]]
        if len(near):
            found.append(forest(x[near].view(np.int64), y[near].view(np.int64)))
        start = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True)))


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def links(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all links would; ``distinct`` has ``fp``."""
    spread = _spread(distinct, _cut_buckets(distinct))
    dealt = spread.repartition("key", "cell").sortWithinPartitions("key", "cell")
    arrow = arrow_schema(_LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(same))  # the last bucket may go on in the next batch
            held = [x[cut:] for x in rows]
            if cut:
                yield compared([x[:cut] for x in rows])
        if held is not None:
            yield compared(held)

    def compared(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, cell, kind, fp = rows
        group = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(group, kind, fp, most)], schema=arrow)

    return map_arrow(dealt, run, _LINKS)


def _rooted(marked: DataFrame, id_col: str, most: int) -> DataFrame:
    """Every fingerprint ``fp`` with ``_least``, the smallest id that has it, and the root of its component."""
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("_least"))
    found = components(links(distinct, most))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the smallest id that links lead to."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col, size))
    rooted = _rooted(marked, id_col, most)
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Documents are told apart by id and text hash: those that share an id without being
    near-duplicates all stay, those without id take part and come last. Of rows equal in both one
    stays.
    """
    place = "_place"
    while place in docs.columns:
        place += "_"
    document = F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"))
    marked = cut_lineage(fingerprints(docs.select(document.alias("_document"), docs[text_col].alias("_text")), "_document", "_text"))
    kept = _rooted(marked, "_document", MOST_BITS).groupBy("root").agg(F.min("_least").alias("_kept"))
    # Equal rows become one in each task before they meet.
    different = docs.withColumn(place, document).dropDuplicates([place])
    return different.join(kept, different[place] == kept["_kept"], "left_semi").drop(place)
