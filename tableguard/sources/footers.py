"""Statistics of Parquet files from their footers, read inside tasks.

Files are listed by Spark (names and sizes, no content), and one job reads the footers: a row per file,
row group and column with rows, bytes, nulls, least and greatest value. Values are texts as the
footer holds them and only serve to choose work; columns that are ``protected`` have none. Tasks
open files by the location's own scheme, for local disks and object stores; ``opener`` takes another way.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ROW = (
    "path string, row_group int, rows long, group_bytes long, column_name string, ordinal int, data_type string, "
    "nulls long, least string, greatest string"
)
#: Files whose footers one task reads, and bytes of the longest value shown.
FILES_PER_TASK, LONGEST = 64, 64


def open_file(path: str):
    """A file to read from, by the scheme of its path."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of all Parquet files below a folder."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return listed.select("path", F.col("length").alias("size"))


def footers(files: DataFrame, protected: Collection[str] = (), opener: Callable[[str], object] = open_file, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """A row per file, row group and column of ``files`` (``path``). A file without rows has none."""
    hidden, longest = {c.lower() for c in protected}, LONGEST

    def shown(value) -> str | None:
        text = value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        return None if value is None or len(text) > longest else text

    def of_file(path: str) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        with opener(path) as source:
            about = pq.ParquetFile(source).metadata
        for g in range(about.num_row_groups):
            group = about.row_group(g)
            for c in range(group.num_columns):
                column = group.column(c)
                known = column.statistics if column.is_stats_set else None
                bounds = (None, None) if known is None or not known.has_min_max or column.path_in_schema.lower() in hidden else (known.min, known.max)
                nulls = known.null_count if known is not None and known.has_null_count else None
                yield path, g, group.num_rows, group.total_byte_size, column.path_in_schema, c + 1, column.physical_type, nulls, shown(bounds[0]), shown(bounds[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(of_file(path))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in _ROW.split(", ")]
    tasks = max(1, -(-files.count() // files_per_task))
    return files.select("path").repartition(tasks).mapInArrow(run, _ROW)


def table_of(path: Column, folder: str) -> Column:
    """Name of the table a file belongs to: the entry of ``folder`` it lies in."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    entry = F.split(F.element_at(F.split(path, F.lit(f"/{name}/")), -1), "/")[0]
    return F.regexp_replace(entry, r"\.parquet$", "")


def table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, files, row_groups, rows and bytes of every table of a folder, from footers."""
    read = footers(files_of(spark, folder))
    groups = read.where("ordinal = 1").withColumn("table_name", table_of(F.col("path"), folder))
    return groups.groupBy("table_name").agg(
        F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("row_groups"), F.sum("rows").alias("rows"), F.sum("group_bytes").alias("bytes")
    )


def column_bounds(spark: SparkSession, folder: str, protected: Collection[str] = ()) -> DataFrame:
    """table_name, column_name, nulls, and whether all row groups tell their bounds."""
    read = footers(files_of(spark, folder), protected).withColumn("table_name", table_of(F.col("path"), folder))
    return read.groupBy("table_name", "column_name").agg(
        F.sum("nulls").alias("nulls"), F.bool_and(F.col("least").isNotNull() & F.col("greatest").isNotNull()).alias("bounded")
    )


def groups_between(read: DataFrame, column: str, low: str, high: str) -> DataFrame:
    """Row groups that may hold text values of a column from ``low`` to ``high``; groups whose footer
    tells nothing are among them."""
    one = read.where(F.col("column_name") == column)
    apart = (F.col("greatest") < low) | (F.col("least") > high)
    return one.where(~F.coalesce(apart, F.lit(False))).select("path", "row_group", "rows")
