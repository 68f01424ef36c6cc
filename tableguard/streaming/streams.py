"""Protection and roll-ups on streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableguard.functions import names as N, values as V
from tableguard.functions.keyed import Key
from tableguard.operators.aliases import alias_registry, apply_aliases
from tableguard.operators.fingerprints import joined, sealed_digest
from tableguard.operators.index import FIELDS, KEY, upsert
from tableguard.operators.protect import protect

REGISTRY = "class string, digest string, alias string"


def protect_stream(sdf: DataFrame, policy: Mapping[str, str] | None, key: Key, **options) -> DataFrame:
    """Protection is stateless, so the batch expressions run unchanged on a stream."""
    return protect(sdf, policy, key, **options)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of ``batch=<id>`` parts, or no rows before the first one exists."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch long")


def alias_sink(
    registry_path: str, out_path: str, columns: Mapping[str, str], key: Callable[[SparkSession], Key]
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that aliases columns (name to class) from a kept registry.

    Each micro-batch first writes its new registry rows, then its output, both under its own
    number and overwriting: a replayed batch sees the registry as it was and repeats the same
    files.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        k = key(spark)
        known = _stored(spark, registry_path, REGISTRY).where(F.col("batch") < batch_id).drop("batch")
        values = None
        for name, cls in columns.items():
            one = batch.select(F.lit(cls).alias("class"), F.col(f"`{name}`").cast("string").alias("value"))
            values = one if values is None else values.unionByName(one)
        alias_registry(values, known, k).write.mode("overwrite").parquet(f"{registry_path}/batch={batch_id}")
        full = _stored(spark, registry_path, REGISTRY).where(F.col("batch") <= batch_id).drop("batch")
        out = batch
        for name, cls in columns.items():
            out = apply_aliases(out, name, cls, full, k)
        out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return run


class BatchConflict(ValueError):
    """A batch number came back with different content."""


def newest_entries(entries: DataFrame) -> DataFrame:
    """Last entry per identity inside one micro-batch."""
    payload = F.struct(*[F.col(c) for c in entries.columns])
    order = F.struct(F.col("submitted_at"), F.to_json(payload)) if "submitted_at" in entries.columns else F.to_json(payload)
    last = entries.groupBy(*KEY).agg(F.max_by(payload, order).alias("row")).select("row.*")
    return last.select(*KEY, *FIELDS)


def index_sink(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that syncs a context index.

    Every batch leaves its content hash in a ledger, and the rows of the identities it names as a
    part of the index; what it costs depends on the batch, but for one scan of the identities kept.
    A replay with the same content changes nothing; the same number with other content is a
    conflict. ``compact_index`` joins old parts from time to time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entries = newest_entries(batch)
        payload = joined(*KEY, *[F.to_json(F.struct(F.col(f))) for f in FIELDS])
        digest = sealed_digest(entries, payload, joined(*KEY)).first()["digest"]
        ledger = _stored(spark, f"{root}/ledger", "digest string")
        seen = ledger.where(F.col("batch") == batch_id).select("digest").first()
        if seen is not None:
            if seen["digest"] != digest:
                raise BatchConflict(f"batch {batch_id} was applied with other content")
            return
        before = read_index(spark, root, before=batch_id, schema=_index_schema(batch))
        touched = before.join(entries.select(*KEY), KEY, "left_semi").select(*before.columns)
        upsert(touched, entries).write.mode("overwrite").parquet(f"{root}/index/batch={batch_id}")
        # The ledger row comes last: a crash before it only repeats the same version.
        spark.createDataFrame([(digest,)], "digest string").write.mode("overwrite").parquet(
            f"{root}/ledger/batch={batch_id}"
        )

    return run


def _index_schema(batch: DataFrame) -> T.StructType:
    fields = [T.StructField(c, batch.schema[c].dataType) for c in KEY + FIELDS]
    return T.StructType([*fields, T.StructField("active", T.BooleanType()), T.StructField("batch", T.LongType())])


def read_index(spark: SparkSession, root: str, before: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The index as of its newest part (below a batch number, when given): of each identity the
    rows of the last part that names it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        versions = reader.parquet(f"{root}/index")
    except AnalysisException:
        if schema is None:
            raise
        versions = spark.createDataFrame([], schema)
    if before is not None:
        versions = versions.where(F.col("batch") < before)
    last = versions.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    return versions.join(last, [*KEY, "batch"], "left_semi").drop("batch")


def compact_index(spark: SparkSession, root: str, target: str) -> None:
    """The newest rows of an index as one part under another root, together with the ledger.

    Run while no batch is being applied, and go on with the new root.
    """
    parts = spark.read.parquet(f"{root}/index")
    last = parts.agg(F.max("batch").alias("b")).first()["b"]
    read_index(spark, root).write.parquet(f"{target}/index/batch={last}")
    spark.read.parquet(f"{root}/ledger").write.partitionBy("batch").parquet(f"{target}/ledger")


def timed(df: DataFrame, time: str, watermark: str) -> DataFrame:
    """A stream gets its watermark, which needs a time with a zone; a table stays as it is."""
    if not df.isStreaming:
        return df
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, watermark)


def audit_rollup(
    events: DataFrame,
    window: str = "5 minutes",
    slide: str | None = None,
    watermark: str = "10 minutes",
    time: str = "occurred_at",
    keys: tuple[str, ...] = ("operation", "outcome"),
) -> DataFrame:
    """Operations per window, with failures and total duration; the same on a table or a stream.

    ``events`` has the time column, the key columns, ``failed`` (boolean) and ``duration_ms``.
    """
    rows = timed(events, time, watermark)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        rows.groupBy(w.alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("failed").alias("failures"),
            F.sum("duration_ms").alias("duration_ms"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "failures", "duration_ms")
    )


def drift_alarm(
    df: DataFrame,
    policy: Mapping[str, str] | None,
    window: str = "1 hour",
    watermark: str = "10 minutes",
    time: str = "occurred_at",
) -> DataFrame:
    """Value classes seen per window and column that the column's own class does not explain."""
    return (
        drift_cells(timed(df, time, watermark), policy, time)
        .groupBy(F.window(time, window).alias("w"), "column_name", "class", "expected_class")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "column_name", "class", "expected_class", "n")
    )


def drift_cells(df: DataFrame, policy: Mapping[str, str] | None, time: str) -> DataFrame:
    """Time, column and class of every text value whose class its column does not explain."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                V.classify_value(F.col(f"`{c}`")).alias("class"),
                F.lit(N.declared_class(c, policy)).alias("expected_class"),
            )
            for c in strings
        ]
    )
    surprise = (F.col("class") != "public") & (F.col("class") != F.col("expected_class"))
    return df.select(F.col(time), F.inline(pairs)).where(surprise)
