"""Reading whole tables and file corpora, and writing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableguard.functions import fixed as X
from tableguard.operators.bundle import inventory


NOT_UTF8 = "FILE_NOT_UTF8"


def read_table_all(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    partitions: int = 32,
    options: Mapping[str, str] | None = None,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """Whole table over JDBC in parallel key ranges; one small query finds the bounds.

    A table without a numeric or date key is read by ``predicates``, conditions that together cover
    every row once, one task each. With neither, one task reads it: for small tables only.
    """
    if predicates is not None:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(options or {}))
    reader = spark.read.format("jdbc").option("url", url).options(**dict(options or {}))
    if key is None:
        return reader.option("dbtable", table).load()
    ends = reader.option("query", f"select min({key}) as lo, max({key}) as hi from {table}").load().first()
    if ends[0] is None:
        return reader.option("dbtable", table).load()
    ranged = spark.read.format("jdbc").option("url", url).options(**dict(options or {}))
    return (
        ranged.option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", str(ends[0]))
        .option("upperBound", str(ends[1]))
        .option("numPartitions", str(partitions))
        .load()
    )


def read_sql_corpus(spark: SparkSession, root: str, pattern: str = "*.sql") -> DataFrame:
    """(path, content, problem) of all matching files below a folder; path is relative, a byte
    order mark is dropped. A file that is not UTF-8 has no content and a problem; the others are
    read all the same."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    base = root.rstrip("/") + "/"
    inside = F.substring_index(F.col("path"), base, -1)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8"))
    bare = F.when(F.startswith(text, F.lit("﻿")), F.substr(text, F.lit(2))).otherwise(text)
    path = F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("path"), bare.alias("content"), F.when(~valid, NOT_UTF8).alias("problem"))


def canonical_json(df: DataFrame) -> Column:
    """Row as compact JSON with sorted keys, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(canonical_json(df).alias("value")).write.mode(mode).text(path)


def write_sample(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    markers: Mapping[str, str] | None = None,
    mode: str = "errorifexists",
    most: int = 20,
) -> None:
    """Masked sample as CSV (markers in the header) or JSON lines (plain names), in one file.

    More rows than ``most`` are refused, since one task writes them.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a sample holds {most} rows at most")
    marks = markers or {f.name: (f.metadata or {}).get("marker", "") for f in df.schema.fields}
    few = df.coalesce(1)
    if fmt == "csv":
        named = few.toDF(*[f"{c} {marks[c]}" if marks.get(c) else c for c in df.columns])
        named.write.mode(mode).option("header", "true").csv(path)
    elif fmt == "json":
        write_json_lines(few, path, mode)
    else:
        raise ValueError("a sample is written as csv or json")


def materialize(df: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Object rows under ``category=<category or unknowns>/folder=<type folder>``."""
    folder = F.create_map(*[F.lit(x) for pair in X.TYPE_FOLDER.items() for x in pair])
    placed = df.withColumn("category", F.coalesce("category", F.lit("unknowns"))).withColumn(
        "folder", folder[F.col("object_type")]
    )
    # One shuffle by target folder; adaptive execution splits large folders and joins small ones.
    placed.hint("rebalance", "category", "folder").write.mode(mode).partitionBy("category", "folder").parquet(root)


def write_manifest(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Manifest of ``path, content`` files as JSON lines."""
    write_json_lines(inventory(files), path, mode)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, size_bytes long, sha256 string").json(path)


def write_index(index: DataFrame, root: str, version: int) -> str:
    """Save an index version under its own path and return that path."""
    target = f"{root.rstrip('/')}/version={version}"
    index.write.mode("errorifexists").parquet(target)
    return target
