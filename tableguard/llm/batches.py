"""Helpers shared by the operators: Arrow batches cut by bytes, hashes and ragged arrays in numpy."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Bytes of text handled at a time inside a task; bounds the memory of numpy work arrays.
SLICE_BYTES = 4 << 20

_M1, _M2, _GOLDEN = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def hand_over(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, as a file Spark serves."""
    context = spark.sparkContext
    if getattr(context, "_tableguard_handed_over", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tableguard-")) / "tableguard_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"{package.name}/{file.relative_to(package)}")
    context.addPyFile(str(archive))
    context._tableguard_handed_over = True


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    hand_over(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_FACTOR = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (nulls have no bytes)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text; a longer text is a part of its own."""
    _, at = column_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: T.StructType, text: str | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with one dictionary of columns for each part of a batch.

    ``text`` names the column whose bytes bound a part.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit) if text else [batch]:
                if part.num_rows and (columns := fn(part)) is not None:
                    yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def keep_rows(df: DataFrame, text: str, mask: Callable[[pa.RecordBatch], np.ndarray], limit: int = SLICE_BYTES) -> DataFrame:
    """Rows whose mask is true, with all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                if part.num_rows:
                    yield part.filter(pa.array(mask(part), type=pa.bool_()))

    return map_arrow(df, run, df.schema)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0 + l1, ... of ragged rows."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, one after the other."""
    at = starts_of(lengths)
    return np.arange(at[-1], dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - at[:-1], lengths)


def id_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def doc_columns(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """The columns an operator reads, under its own names, so that others cannot clash."""
    return df.select(*(df[source].alias(name) for source, name in pairs))


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
