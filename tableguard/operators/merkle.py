"""Inventories as hash trees: two of them are compared from the root, and only where they differ are
their rows read.

A row's place is the hash of its key in hex; a node of level d holds the rows whose place begins with
its d digits, and its hash is the SHA-256 over its sorted row hashes (leaves) or over its children
(16 at most). Places are hashes, not folders, so leaves are of even size however the paths look.
A stored tree is ``files`` (rows, partitioned by leaf) and ``nodes`` (one part per level). Two trees
that are compared have the same depth; 16^depth leaves suit about a thousand times as many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableguard.operators.fingerprints import joined

#: Digits of a leaf; a comparison holds up to 16^DEPTH prefixes on the driver, so they stay few.
DEPTH, MOST_DEPTH = 3, 4

_NODE = "prefix string, rows long, hash string"


def row_hash(items: DataFrame, payload: Sequence[str]) -> Column:
    return F.sha2(joined(*[items[c] for c in payload]), 256)


def leaf_of(key: Column, depth: int) -> Column:
    return F.substring(F.sha2(key, 256), 1, depth)


def _leaves(files: DataFrame, payload: Sequence[str]) -> DataFrame:
    return files.groupBy(F.col("leaf").alias("prefix")).agg(
        F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(row_hash(files, payload))), ""), 256).alias("hash")
    )


def _parents(nodes: DataFrame, digits: int) -> DataFrame:
    """Nodes one level up; a parent has 16 children at most."""
    children = F.array_sort(F.collect_list(F.struct("prefix", "hash")))
    whole = F.array_join(F.transform(children, lambda c: F.concat(c["prefix"], c["hash"])), "")
    return nodes.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(F.sum("rows").alias("rows"), F.sha2(whole, 256).alias("hash"))


def write_tree(items: DataFrame, folder: str, key: str = "path", payload: Sequence[str] = ("path", "size_bytes", "sha256"), depth: int = DEPTH) -> None:
    """Store an inventory as a tree. A column named ``leaf`` is refused, as the tree adds one."""
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"a tree has 1 to {MOST_DEPTH} levels")
    if "leaf" in (c.lower() for c in items.columns):
        raise ValueError("a column is named leaf")
    spark = items.sparkSession
    placed = items.withColumn("leaf", leaf_of(F.coalesce(F.col(key), F.lit("")), depth))
    items.limit(0).write.parquet(f"{folder}/schema")  # an empty inventory has no other file
    placed.repartition("leaf").write.partitionBy("leaf").parquet(f"{folder}/files")
    nodes = _leaves(spark.read.schema(placed.schema).parquet(f"{folder}/files"), payload)
    for level in range(depth, -1, -1):
        # Each level is written from the one below it. Few rows: 16^level.
        nodes.coalesce(1 if level < depth else 8).write.parquet(f"{folder}/nodes/level={level}")
        nodes = _parents(_level(spark, folder, level), level - 1) if level else nodes


def _level(spark: SparkSession, folder: str, level: int) -> DataFrame:
    return spark.read.schema(_NODE).parquet(f"{folder}/nodes/level={level}")


def root(spark: SparkSession, folder: str) -> DataFrame:
    """rows and hash of a whole stored inventory."""
    return _level(spark, folder, 0).select("rows", "hash")


def differing_leaves(spark: SparkSession, old: str, new: str, depth: int = DEPTH) -> list[str]:
    """Leaves that differ, found from the root down; at most 16^depth short texts.

    A level is read only below the nodes that differ in the level above.
    """
    differ = [""]
    for level in range(depth + 1):
        sides = [_level(spark, f, level) for f in (old, new)]
        if level:
            sides = [s.where(F.substring("prefix", 1, level - 1).isin(differ)) for s in sides]
        a, b = (s.select("prefix", F.col("hash").alias(n)) for s, n in zip(sides, ("a", "b")))
        rows = a.join(b, "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix").collect()
        differ = sorted(r.prefix for r in rows)
        if not differ:
            return []
    return differ


def branch(spark: SparkSession, folder: str, leaves: Sequence[str]) -> DataFrame:
    """Rows below the given leaves; other partitions are not read."""
    schema = spark.read.parquet(f"{folder}/schema").schema
    files = spark.read.schema(T.StructType([*schema.fields, T.StructField("leaf", T.StringType())])).parquet(f"{folder}/files")
    return files.where(F.col("leaf").isin(list(leaves))).drop("leaf")


def changes(spark: SparkSession, old: str, new: str, key: str = "path", content: str = "sha256", depth: int = DEPTH) -> DataFrame:
    """key, kind (``added``, ``removed`` or ``changed``), and the content before and after."""
    leaves = differing_leaves(spark, old, new, depth)
    a, b = (
        branch(spark, f, leaves).select(F.col(key).alias(f"key_{n}"), F.col(content).alias(n), F.lit(True).alias(f"in_{n}"))
        for f, n in ((old, "before"), (new, "after"))
    )
    both = a.join(b, F.col("key_before").eqNullSafe(F.col("key_after")), "full")
    kind = (
        F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    place = F.when(F.col("in_before").isNull(), F.col("key_after")).otherwise(F.col("key_before"))
    return both.select(place.alias(key), kind.alias("kind"), "before", "after").where(F.col("kind").isNotNull())
