"""Token counts of whole texts with a public tokenizer, lengths only.

A text is cut at ASCII white space, where neither the normaliser (composition, folding of white
space, lower case) nor the splitting pattern nor an added token can reach across, so the counts of
the pieces add up to the count of the text. Each different piece of a part of a batch is encoded
once; parts are balanced by bytes and results are remembered per Python worker.

Null texts count as empty; a text without white space is one piece whatever its length; repeated
rows give repeated results; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tableguard.llm.batches import doc_columns, id_type, map_batches

#: Counts remembered per worker, and the longest piece that is remembered.
REMEMBERED, LONGEST = 400_000, 48
#: Bytes given to the tokenizer at once.
ENCODE_BYTES = 1 << 20

_COUNTS: dict[str, dict[str, int]] = {}
_CODERS: dict[str, object] = {}


def _json_counter(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    return lambda pieces: [len(x) for x in coder.encode_batch_fast(pieces, add_special_tokens=False)]


def _model_counter(path: str):
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in coder.encode(texts, num_threads=1)]


def _coder(path: str):
    if path not in _CODERS:
        _CODERS[path] = _json_counter(path) if path.endswith(".json") else _model_counter(path)
    return _CODERS[path]


def _encode(path: str, pieces: list[str]) -> list[int]:
    """Counts of the pieces, encoded in batches of about equal bytes."""
    out, batch, size = [], [], 0
    for piece in pieces:
        batch.append(piece)
        size += len(piece) + 16
        if size >= ENCODE_BYTES:
            out += _coder(path)(batch)
            batch, size = [], 0
    return out + (_coder(path)(batch) if batch else [])


def count_texts(texts: list[str], path: str) -> list[int]:
    """Token counts of the texts."""
    if not path.endswith(".json"):  # white space is part of these pieces; the texts stay whole
        return _encode(path, texts)
    known = _COUNTS.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
    fresh = list({p for pieces in split for p in pieces if p not in known})
    counts = dict(zip(fresh, _encode(path, fresh), strict=True))
    known.update((p, n) for p, n in counts.items() if len(p) <= LONGEST)
    if len(counts) and any(len(p) > LONGEST for p in fresh):
        get = lambda p: known[p] if p in known else counts[p]
    else:
        get = known.__getitem__
    return [sum(map(get, pieces)) for pieces in split]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every text, with the tokenizer file at ``path``."""
    schema = T.StructType([
        T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
    ])

    def part(batch: pa.RecordBatch) -> dict:
        import pyarrow.compute as pc

        column = batch.column("_text").fill_null("")
        counts = count_texts(column.to_pylist(), path)
        return {id_col: batch.column("_id"), "n_bytes": pc.binary_length(column), "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_batches(doc_columns(docs, (id_col, "_id"), (text_col, "_text")), part, schema, "_text")
