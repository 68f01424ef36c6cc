"""Exact duplicates by a stream with keyed state on disk. DataFrame and SQL functions only.

Documents stream in from their files and leave an entry each in a ledger: id, digest of the
normalised text, and locator (file and row in it). A second stream reads the ledger and keeps, in a
RocksDB state store without expiry, one entry for each digest key: the largest id, the locator of
its row, and how many rows came. Both streams end when all files are read and go on with new files
when called again with the same state folder; nothing is read or counted twice.

``decide`` takes the entries out of the state store. Rows whose entry counts one row stand alone.
All others are hits, and hits are checked by their full bytes: the content at the locator must be both
the least and the greatest text of its key. Keys where it is not hold different texts, and
those are told apart by the texts themselves. So results are exact for keys of any length.

Hot texts: counts and extremes are aggregated before they are shuffled, and of keys with more than a
``1 / HOT`` of all rows, which are fewer than ``HOT``, the entries are broadcast.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts
the row with the largest id stays; a row without id stays only if no equal row has one, and of rows
with that same id the last by file and row. An empty table gives no rows. Other columns are not read.
Files must not change once they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableguard.llm.batches import lower_ascii
from tableguard.llm.tables import new_folder, remove, written
from tableguard.session import cut_lineage

#: Bytes of the SHA-256 that the state is keyed by.
KEY_BYTES = 16
#: Ledger rows of a batch, batches at least, ledger rows for each partition of the state, and such partitions at least.
BATCH_ROWS, LEAST_BATCHES, STATE_ROWS, LEAST_PARTITIONS = 50_000_000, 2, 2_000_000, 8
#: Keys with more than this part of the rows are hot.
HOT = 1000
#: Hits that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_HITS = 50_000

_STORE = "spark.sql.streaming.stateStore."
#: State on disk; the partitions of an executor share the memory for blocks and for writing.
STATE_SETTINGS = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "256",
    f"{_STORE}rocksdb.writeBufferSizeMB": "8",
    f"{_STORE}rocksdb.allowFAllocate": "false",  # a small partition would take 4 MB ahead
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(lower_ascii(text))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream starts, which keeps them, or while state is read."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files(path: str) -> str:
    """The path as a pattern, since a stream takes a single file only by a pattern."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{{{name}}}"


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and locator of every row."""
    at = docs.metadataColumn("_metadata")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), at["file_path"].alias("file"), at["row_index"].alias("row"))


def _ledger_schema(id_kind: T.DataType) -> T.StructType:
    fields = [("id", id_kind), ("digest", T.BinaryType()), ("file", T.StringType()), ("row", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def absorb(
    spark: SparkSession, path: str, state: str, batches: int | None = None, partitions: int | None = None, key_bytes: int = KEY_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Take the Parquet files at ``path`` that are new since the last call into the folder
    ``state``; the whole ledger. The number of partitions is settled by the first call."""
    schema = spark.read.parquet(path).schema
    arriving = _located(spark.readStream.schema(schema).parquet(_files(path)), id_col, text_col)
    entries = arriving.select("id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), "file", "row")
    entries.writeStream.format("parquet").option("checkpointLocation", f"{state}/read").trigger(availableNow=True).start(f"{state}/ledger").awaitTermination()
    known = _ledger_schema(schema[id_col].dataType)
    ledger = spark.read.schema(known).parquet(f"{state}/ledger")
    rows = ledger.count()
    if not rows:
        return ledger
    files = -(-len(ledger.inputFiles()) // (batches or max(LEAST_BATCHES, -(-rows // BATCH_ROWS))))
    held = (
        spark.readStream.schema(known).option("maxFilesPerTrigger", str(files)).parquet(f"{state}/ledger")
        .withColumn("key", F.substring("digest", 1, key_bytes)).groupBy("key")
        .agg(F.max(F.struct("id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("size"))
    )
    count = partitions or max(LEAST_PARTITIONS, -(-rows // STATE_ROWS))
    with _settings(spark, STATE_SETTINGS | {"spark.sql.shuffle.partitions": str(count)}):
        query = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{state}/keyed").trigger(availableNow=True).start()
    query.awaitTermination()
    return ledger


def entries(spark: SparkSession, state: str) -> DataFrame:
    """key, kept (id and locator of the row that stays) and size, as the state store holds them."""
    held = spark.read.format("statestore").load(f"{state}/keyed")
    return held.select("key.key", F.col("value.max").alias("kept"), F.col("value.count").alias("size"))


def _linked(ledger: DataFrame, found: DataFrame, key_bytes: int) -> DataFrame:
    """Every row of the ledger with the entry of its key."""
    rows = ledger.withColumn("key", F.substring("digest", 1, key_bytes))
    total = found.agg(F.sum("size")).first()[0]
    hot = F.broadcast(found.where(F.col("size") * HOT > total))
    cold = found.where(F.col("size") * HOT <= total)
    return rows.join(hot, "key").unionByName(rows.join(hot, "key", "left_anti").join(cold, "key"))


def decide(
    spark: SparkSession, path: str, ledger: DataFrame, state: str, folder: str, key_bytes: int = KEY_BYTES, broadcast_hits: int = BROADCAST_HITS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row of the ledger.

    ``folder`` takes intermediate tables that the result reads.
    """
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    if ledger.isEmpty():
        return ledger.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    with _settings(spark, STATE_SETTINGS):
        held = written(entries(spark, state), f"{folder}/entries")
    linked = written(_linked(ledger, held, key_bytes), f"{folder}/linked")
    # By null-safe places, as nothing else tells rows with equal or missing ids apart.
    stays = (F.col("kept.file") == F.col("file")) & (F.col("kept.row") == F.col("row"))
    hits = linked.where(F.col("size") > 1).select("id", "file", "row", "key", stays.alias("stays"))
    located = _located(spark.read.parquet(path), id_col, text_col).select("file", "row", normalised(F.col("text")).alias("text"))
    few = F.broadcast(hits) if hits.count() <= broadcast_hits else hits
    texts = located.join(few, ["file", "row"])
    checked = texts.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("most"), F.max(F.when(F.col("stays"), F.col("text"))).alias("at_locator"))
    same = (F.col("least") == F.col("at_locator")) & (F.col("most") == F.col("at_locator"))
    differing = written(checked.where(~same).select("key"), f"{folder}/differing")
    decided = linked.select("id", "file", "row", "digest", "kept", "size", "key")
    if not differing.isEmpty():
        mixed = texts.join(differing, "key", "left_semi")
        apart = mixed.groupBy("key", "text").agg(F.max(F.struct("id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("size"))
        own = mixed.join(apart, ["key", "text"]).select("file", "row", F.col("kept").alias("_kept"), F.col("size").alias("_size"))
        decided = decided.join(own, ["file", "row"], "left").withColumns({"kept": F.coalesce("_kept", "kept"), "size": F.coalesce("_size", "size")})
    return decided.select(F.col("id").alias(id_col), F.col("kept.id").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), sha)


def deduplicate(
    spark: SparkSession, path: str, state: str | None = None, key_bytes: int = KEY_BYTES, batches: int | None = None, partitions: int | None = None,
    broadcast_hits: int = BROADCAST_HITS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Decisions on all documents that the Parquet files at ``path`` hold.

    ``state`` is a shared folder that is kept and taken up again by the next call, with the same
    path and parameters; without one, a new folder is used and removed.
    """
    folder = new_folder(spark, "exact")
    at = state or f"{folder}/state"
    ledger = absorb(spark, path, at, batches, partitions, key_bytes, id_col, text_col)
    out = cut_lineage(decide(spark, path, ledger, at, folder, key_bytes, broadcast_hits, id_col, text_col))
    remove(spark, folder)
    return out
