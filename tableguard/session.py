"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tableguard", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors share one disk, falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="tableguard-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder, so a lost executor does not force a recompute."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_STORE = "spark.sql.streaming.stateStore."
#: Keyed state on disk; the partitions of an executor share the memory for blocks and for writing.
STATE_ON_DISK = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "256",
    f"{_STORE}rocksdb.writeBufferSizeMB": "8",
    f"{_STORE}rocksdb.allowFAllocate": "false",  # a small partition would take 4 MB ahead
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream started inside keeps its state in RocksDB; the session's settings come back after."""
    before = {k: spark.conf.get(k, None) for k in STATE_ON_DISK}
    for k, v in STATE_ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
