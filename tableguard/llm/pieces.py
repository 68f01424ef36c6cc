"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary of a public BPE model is used: the best-scored adjacent pair whose concatenation is
a piece is merged first, the leftmost of equals. Each candidate merge is skipped for good if a
keyed hash of (seed, document, unit, the candidate's place) falls below the dropout, so encoding is
repeatable, differs between occurrences, and with dropout 0 equals the library's.

No piece crosses from a character to a following blank, so blanks-and-word units are independent.
All units of a part of a batch are merged side by side in numpy, one merge per unit and step; units
of more than ``LONGEST`` characters use an agenda on a heap, with the same hashes. Characters
without a piece, and the mark U+2581 itself, become byte pieces, so decoding returns every text
exactly.

Null and empty texts have no pieces; repeated rows are encoded alike; rows without id have the key
of no id; other columns are not read by ``encode``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableguard.llm.batches import arrow_schema, id_type, map_arrow, map_batches, mix64, ranges, slices, starts_of

BLANK = "▁"
#: Characters of the longest unit that is merged side by side with others; cells of a work array.
LONGEST, CELLS = 64, 1 << 20
#: Bytes of text handled at a time.
PART_BYTES = 1 << 20
_NEVER = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model as arrays."""

    of_char: np.ndarray  # symbol of each code point, -1 if none
    pieces: int  # symbols from here on are characters that occur in pieces only
    byte: np.ndarray  # piece of each byte
    table_keys: np.ndarray  # open hash table of mergeable pairs
    table_piece: np.ndarray
    priority: np.ndarray  # of each piece, smaller merges first
    data: np.ndarray  # what the pieces decode to, one after the other
    at: np.ndarray

    @staticmethod
    def load(path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(model)
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        symbols = {name: i for i, name in enumerate(names) if not special[i]}
        for name in list(symbols):
            for c in name:
                symbols.setdefault(c, len(symbols) + n)
        of_char = np.full(0x110000, -1, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                of_char[ord(name)] = i
        of_char[ord(" ")], of_char[ord(BLANK)] = of_char[ord(BLANK)], -1
        scores = [-model.get_score(i) for i in range(n)]
        rank = {s: k for k, s in enumerate(sorted(set(scores)))}
        pairs = {}
        for name, i in symbols.items():
            if i < n:
                for k in range(1, len(name)):
                    if name[:k] in symbols and name[k:] in symbols:
                        pairs[symbols[name[:k]] << 32 | symbols[name[k:]]] = i
        keys, piece = _hash_table(pairs)
        values = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(BLANK, " ").encode() for i, name in enumerate(names)]
        byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        return Vocabulary(of_char, n, byte, keys, piece, np.array([rank[s] for s in scores], np.int32), np.frombuffer(b"".join(values), np.uint8), starts_of(np.array([len(v) for v in values])))

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two symbols make, -1 if none."""
        keys = left.astype(np.int64) << 32 | right
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = _slots(keys[todo], len(self.table_keys))
        while len(todo):
            there = self.table_keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.table_piece[slot[hit]]
            go = ~hit & (there >= 0)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.table_keys) - 1)
        return out


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _hash_table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << (4 * len(pairs) + 1).bit_length()
    keys, values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
    for key, slot in zip(pairs, _slots(np.array(list(pairs), np.int64), size).tolist(), strict=True):
        while keys[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        keys[slot], values[slot] = key, pairs[key]
    return keys, values


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.load(path)
    return _VOCABULARIES[path]


def _candidates(v: Vocabulary, left: np.ndarray, right: np.ndarray, key: np.ndarray, spot: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Priority and piece of merging neighbours; ``spot`` is where they begin, meet and end."""
    piece = v.merged(left, right)
    priority = np.where(piece >= 0, v.priority[np.maximum(piece, 0)], _NEVER)
    if limit:
        priority[mix64(key ^ mix64(spot)) < limit] = _NEVER
    return priority, piece


def _spot(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)


def _merge_together(v: Vocabulary, symbols: np.ndarray, key: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Merge all rows of a matrix of symbols (-2 beyond the end); dead places become -3.

    Symbols form a linked list in each row. Each step takes the best candidate of every row.
    """
    n, width = symbols.shape
    sym = symbols.copy()
    length = (sym != -2).sum(axis=1)
    after = np.tile(np.arange(1, width + 1), (n, 1))  # start of the next symbol
    ahead = np.tile(np.arange(-1, width - 1), (n, 1))  # start of the one before
    best, piece = np.full((n, width), _NEVER, np.int32), np.full((n, width), -1, np.int32)
    r, c = np.nonzero(sym[:, :-1] >= 0)
    best[r, c], piece[r, c] = _candidates(v, sym[r, c], sym[r, c + 1], key[r], _spot(c, c + 1, c + 2), limit)
    rows = np.arange(n)
    while len(rows):
        at = best[rows].argmin(axis=1)
        go = best[rows, at] < _NEVER
        rows, at = rows[go], at[go]
        if not len(rows):
            break
        gone = after[rows, at]
        end = after[rows, gone]
        sym[rows, at], sym[rows, gone] = piece[rows, at], -3
        best[rows, gone] = _NEVER
        after[rows, at] = end
        inside = end < length[rows]
        ahead[rows[inside], end[inside]] = at[inside]
        # The new symbol with the next one, and with the one before.
        best[rows, at] = _NEVER
        _renew(v, sym, best, piece, after, rows[inside], at[inside], key, limit)
        first = ahead[rows, at]
        _renew(v, sym, best, piece, after, rows[first >= 0], first[first >= 0], key, limit)
    return sym


def _renew(v: Vocabulary, sym: np.ndarray, best: np.ndarray, piece: np.ndarray, after: np.ndarray, rows: np.ndarray, at: np.ndarray, key: np.ndarray, limit: np.uint64) -> None:
    middle = after[rows, at]
    best[rows, at], piece[rows, at] = _candidates(v, sym[rows, at], sym[rows, middle], key[rows], _spot(at, middle, after[rows, middle]), limit)


_ALL = (1 << 64) - 1


def _mix(x: int) -> int:
    """``mix64`` of one plain number."""
    x = (x + 0x9E3779B97F4A7C15) & _ALL
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _ALL
    return x ^ x >> 31


def _merge_long(v: Vocabulary, symbols: np.ndarray, key: np.uint64, limit: np.uint64) -> np.ndarray:
    """The same for one long unit, with an agenda."""
    n = len(symbols)
    sym = symbols.tolist()
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    c = np.arange(n - 1)
    best, piece = _candidates(v, symbols[:-1], symbols[1:], np.full(n - 1, key), _spot(c, c + 1, c + 2), limit)
    # What two symbols make is looked up once a unit; whether a place is skipped is plain arithmetic.
    made: dict[int, tuple[int, int]] = {}
    number, bound = int(key), int(limit)

    def candidate(left: int, right: int, spot: int) -> tuple[int, int]:
        if left < 0 or right < 0 or bound and _mix(number ^ _mix(spot)) < bound:
            return _NEVER, -1
        pair = left << 32 | right
        if pair not in made:
            merged = int(v.merged(np.array([left]), np.array([right]))[0])
            made[pair] = (int(v.priority[merged]) if merged >= 0 else _NEVER, merged)
        return made[pair]

    agenda = [(b, s, s + 1, s + 2, p) for b, s, p in zip(best.tolist(), c.tolist(), piece.tolist(), strict=True) if b < _NEVER]
    heapq.heapify(agenda)

    def push(start: int) -> None:
        middle = after[start]
        if middle < n:
            end = after[middle]
            b, p = candidate(sym[start], sym[middle], (start << 42 ^ middle << 21 ^ end) & _ALL)
            if b < _NEVER:
                heapq.heappush(agenda, (b, start, middle, end, p))

    while agenda:
        _, start, middle, end, merged = heapq.heappop(agenda)
        if sym[start] == -3 or after[start] != middle or sym[middle] == -3 or after[middle] != end:
            continue
        sym[start], sym[middle], after[start] = merged, -3, end
        if end < n:
            ahead[end] = start
        push(start)
        if ahead[start] >= 0:
            push(ahead[start])
    return np.array(sym, np.int32)


def encode_texts(texts: list[str], keys: np.ndarray, v: Vocabulary, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of all texts, and the offsets of the texts; ``keys`` has one number each."""
    marked = [" " + t if t else "" for t in texts]  # the dummy blank before a text
    text_at = starts_of(np.array([len(t) for t in marked], np.int64))
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    blank = points == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[text_at[:-1][np.diff(text_at) > 0]] = True
    unit_at = np.append(np.flatnonzero(begins), len(points))
    size = np.diff(unit_at)
    owner = np.searchsorted(text_at, unit_at[:-1], side="right") - 1
    number = np.arange(len(size)) - np.searchsorted(unit_at[:-1], text_at)[owner]
    key = mix64(keys.astype(np.uint64)[owner] ^ mix64(number.astype(np.uint64)))
    limit = np.uint64(min(int(dropout * 2.0**64), (1 << 64) - 1))
    symbols = v.of_char[points]
    result = symbols.copy()
    for low, high in ((1, 4), (4, 8), (8, 12), (12, 20), (20, 36), (36, LONGEST)):
        chosen = np.flatnonzero((size > low) & (size <= high))
        for part in np.array_split(chosen, max(1, -(-len(chosen) * high // CELLS))):
            if len(part):
                index = unit_at[part][:, None] + np.arange(high)
                real = np.arange(high) < size[part][:, None]
                matrix = np.where(real, symbols[np.minimum(index, len(symbols) - 1)], -2)
                result[index[real]] = _merge_together(v, matrix, key[part], limit)[real]
    for unit in np.flatnonzero(size > LONGEST).tolist():
        a, b = unit_at[unit], unit_at[unit + 1]
        result[a:b] = _merge_long(v, symbols[a:b], key[unit], limit)
    return _ids(result, points, text_at, v)


def _ids(result: np.ndarray, points: np.ndarray, text_at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as ids of pieces, those without a piece as their bytes."""
    raw = (result == -1) | (result >= v.pieces)
    bytes_of = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = starts_of(np.where(result == -3, 0, np.where(raw, bytes_of, 1)))
    ids = np.empty(at[-1], np.int32)
    plain = (result >= 0) & ~raw
    ids[at[:-1][plain]] = result[plain]
    where = np.flatnonzero(raw)
    if len(where):
        encoded = "".join(map(chr, points[where].tolist())).encode()
        ids[ranges(at[where], bytes_of[where])] = v.byte[np.frombuffer(encoded, np.uint8)]
    return ids, at[text_at]


def decode_ids(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of the ids, without the dummy blank."""
    lengths = (v.at[1:] - v.at[:-1])[ids]
    data = v.data[ranges(v.at[ids], lengths)].tobytes()
    cuts = starts_of(lengths)[at].tolist()
    return [data[a + 1 : b].decode() if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _key(id_column: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_column)


def encode(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids of the pieces, their number, and whether they decode to the same text."""
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("pieces", T.ArrayType(T.IntegerType())),
        T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType()),
    ])

    def part(batch: pa.RecordBatch) -> dict:
        v = vocabulary(path)
        texts = batch.column("_text").fill_null("").to_pylist()
        ids, at = encode_texts(texts, batch.column("_key").to_numpy().view(np.uint64), v, dropout)
        same = [a == b for a, b in zip(texts, decode_ids(ids, at, v), strict=True)]
        return {id_col: batch.column("_id"), "pieces": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), "n_pieces": np.diff(at), "lossless": same}

    narrow = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), _key(docs[id_col], seed).alias("_key"))
    return map_batches(narrow, part, schema, "_text", PART_BYTES)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """id and text of rows of pieces; null pieces give an empty text."""
    schema = T.StructType([T.StructField(id_col, id_type(encoded, id_col)), T.StructField(text_col, T.StringType())])

    def part(batch: pa.RecordBatch) -> dict:
        lists = batch.column("_pieces").cast(pa.large_list(pa.int32()))
        filled = [x or [] for x in lists.to_pylist()]
        at = starts_of(np.array([len(x) for x in filled], np.int64))
        ids = np.array([i for x in filled for i in x], np.int64)
        return {id_col: batch.column("_id"), text_col: decode_ids(ids, at, vocabulary(path))}

    narrow = encoded.select(encoded[id_col].alias("_id"), encoded[pieces_col].alias("_pieces"))
    return map_batches(narrow, part, schema)


def with_pieces(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text as it decodes from its pieces, and two more columns.

    ``pieces`` and ``n_pieces`` get underscores where the table has such columns already.
    """
    names = []
    for name in ("_key", "pieces", "n_pieces"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    key, pieces, count = names
    schema = T.StructType([*docs.schema.fields, T.StructField(pieces, T.ArrayType(T.IntegerType())), T.StructField(count, T.LongType())])
    arrow, place = arrow_schema(schema), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for part in slices(batch, place, PART_BYTES):
                column = part.column(place)
                ids, at = encode_texts(column.fill_null("").to_pylist(), part.column(part.num_columns - 1).to_numpy().view(np.uint64), v, dropout)
                decoded = pa.array(decode_ids(ids, at, v), column.type)
                columns = [pc.if_else(pc.is_valid(column), decoded, None) if k == place else c for k, c in enumerate(part.columns[:-1])]
                columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(np.diff(at))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return map_arrow(docs.withColumn(key, _key(docs[id_col], seed)), run, schema)
