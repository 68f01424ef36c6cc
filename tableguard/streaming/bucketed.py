"""A context index laid out by hash of identity, so that a batch reads and writes its buckets only.

``data/batch=<id>/bucket=<b>`` holds the rows of the identities a batch named; ``manifest/version=<id>``
lists the parts that make up the index after that batch, with the batch's digest. A version counts
once Spark has marked it as complete (``_SUCCESS``, written last), so readers see the version before
or the one after, never a mixture. A bucket that has gathered ``most_parts`` parts is written as one
part by the next batch that reads it anyway. Old versions stay readable until ``vacuum``.

A manifest has at most buckets times parts rows, whatever the size of the index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableguard.operators.fingerprints import joined, sealed_digest
from tableguard.operators.index import FIELDS, KEY, upsert
from tableguard.streaming.streams import BatchConflict, newest_entries

BUCKETS, MOST_PARTS = 4096, 8

Part = tuple[int, int]  # bucket, batch


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done)


def _manifest(spark: SparkSession, root: str, version: int) -> tuple[list[Part], str]:
    rows = spark.read.schema("bucket int, batch long, digest string").parquet(f"{root}/manifest/version={version}").collect()
    return [(r.bucket, r.batch) for r in rows if r.bucket is not None], rows[0].digest


def _row_schema(batch: DataFrame) -> T.StructType:
    return T.StructType([*(T.StructField(c, batch.schema[c].dataType) for c in KEY + FIELDS), T.StructField("active", T.BooleanType())])


def _rows(spark: SparkSession, root: str, parts: Collection[Part], schema: T.StructType) -> DataFrame:
    """Newest row of each identity in the given parts; no other part is listed or read."""
    placed = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    paths = [f"{root}/data/batch={batch}/bucket={bucket}" for bucket, batch in sorted(parts)]
    rows = spark.read.schema(placed).option("basePath", f"{root}/data").parquet(*paths) if paths else spark.createDataFrame([], placed)
    last = rows.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*KEY, "batch"], "left_semi").drop("batch")


def read_bucketed(spark: SparkSession, root: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
    """The index as of its newest version, or of an older one."""
    done = _versions(spark, root)
    if not done:
        raise ValueError(f"no index at {root}")
    parts, _ = _manifest(spark, root, done[-1] if version is None else version)
    schema = schema or spark.read.parquet(f"{root}/schema").schema
    return _rows(spark, root, parts, schema).drop("bucket")


def parts_of(spark: SparkSession, root: str, entries: DataFrame, buckets: int = BUCKETS) -> list[Part]:
    """Parts that a batch has to read."""
    done = _versions(spark, root)
    touched = {r[0] for r in entries.select(bucket_of(buckets)).distinct().collect()}
    return [p for p in (_manifest(spark, root, done[-1])[0] if done else []) if p[0] in touched]


def bucketed_sink(root: str, buckets: int = BUCKETS, most_parts: int = MOST_PARTS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that syncs the index at ``root``, always with the same ``buckets``.

    A batch that comes again with the same content changes nothing; with other content, or behind
    a newer version that never saw it, it is a conflict.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, schema = batch.sparkSession, _row_schema(batch)
        entries = newest_entries(batch)
        payload = joined(*KEY, *[F.to_json(F.struct(F.col(f))) for f in FIELDS])
        digest = sealed_digest(entries, payload, joined(*KEY)).first()["digest"]
        done = _versions(spark, root)
        if done and batch_id <= done[-1]:
            if batch_id not in done or _manifest(spark, root, batch_id)[1] != digest:
                raise BatchConflict(f"batch {batch_id} was applied with other content")
            return
        if not done:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/schema")
        parts = _manifest(spark, root, done[-1])[0] if done else []
        placed = entries.withColumn("bucket", bucket_of(buckets))
        touched = {r.bucket for r in placed.select("bucket").distinct().collect()}
        held = Counter(bucket for bucket, _ in parts)
        crowded = sorted(b for b in touched if held[b] >= most_parts)
        before = _rows(spark, root, [p for p in parts if p[0] in touched], schema)
        named = upsert(before.drop("bucket").join(entries.select(*KEY), KEY, "left_semi").select(*schema.names), entries)
        out = named.select(*schema.names).withColumn("bucket", bucket_of(buckets))
        if crowded:
            rest = before.where(F.col("bucket").isin(crowded)).join(entries.select(*KEY), KEY, "left_anti")
            out = out.unionByName(rest.select(*schema.names, "bucket"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/batch={batch_id}")
        now = [p for p in parts if p[0] not in set(crowded)] + [(b, batch_id) for b in sorted(touched)]
        rows = [(b, n, digest) for b, n in now] or [(None, None, digest)]
        # The version counts from here on; a crash before only repeats the batch.
        spark.createDataFrame(rows, "bucket int, batch long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={batch_id}")

    return run


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete parts that the newest version no longer lists; how many. No one may read older ones."""
    done = _versions(spark, root)
    listed = {p for v in done for p in _manifest(spark, root, v)[0]}
    gone = listed - set(_manifest(spark, root, done[-1])[0]) if done else set()
    for bucket, batch in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/batch={batch}/bucket={bucket}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)
