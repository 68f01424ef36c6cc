"""Streams whose memory is keyed state in the state store: drift that is told once, and aliases.

State is kept on disk by RocksDB (``state_on_disk``) and touched by key, so a batch costs what it
names, however much was seen before. What reaches a key is aggregated or made distinct before it is
shuffled; hot columns and hot values do not send their rows to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from tableguard.functions import fixed as X
from tableguard.functions.keyed import Key
from tableguard.operators.aliases import CODE, STEP, alias_digest, encode_digest, salted_alias
from tableguard.session import state_on_disk
from tableguard.streaming.streams import drift_cells, timed

_CLASSES = "column_name string, class string, expected_class string, window_start timestamp, n long"


def new_classes(
    df: DataFrame,
    policy: Mapping[str, str] | None,
    window: str = "1 hour",
    watermark: str = "10 minutes",
    time: str = "occurred_at",
    forget_after: float | None = None,
) -> DataFrame:
    """Each class that a column of a stream did not hold before, once, with the window it came in
    and how often it stood there.

    Windows are counted natively and handed on when the watermark closes them, so a column reaches
    its state as a row per window and class. Rows behind the watermark are dropped and counted by
    Spark. A class not seen for ``forget_after`` seconds of event time is new again; timers take it
    out of the state.
    """
    counted = (
        drift_cells(timed(df, time, watermark), policy, time)
        .groupBy(F.window(time, window).alias("window"), "column_name", "class", "expected_class")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column_name", "class", "expected_class", F.col("window.start").alias("window_start"), F.window_time("window").alias("at"), "n")
    )
    # The processor is defined here so that it travels to the workers by its code.
    forget_ms = None if forget_after is None else int(forget_after * 1000)

    class Seen(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getMapState("last", "class string, expected_class string", "at_ms long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            for r in sorted(rows, key=lambda r: (r.at, r["class"], r.expected_class)):
                place = (r["class"], r.expected_class)
                at = int(r.at.timestamp() * 1000)
                last = self.last.getValue(place)[0] if self.last.containsKey(place) else None
                if last is None or forget_ms is not None and at - last > forget_ms:
                    yield Row(column_name=key[0], **{"class": r["class"]}, expected_class=r.expected_class, window_start=r.window_start, n=r.n)
                if last is None or at > last:
                    self.last.updateValue(place, (at,))
                    if forget_ms is not None:
                        self.handle.registerTimer(at + forget_ms + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            due = expiredTimerInfo.getExpiryTimeInMs()
            for place, (last,) in list(self.last.iterator()):
                if last + forget_ms < due:
                    self.last.removeKey(place)
            return iter(())

        def close(self) -> None: ...

    return counted.groupBy("column_name").transformWithState(Seen(), _CLASSES, "append", "eventTime")


def register_aliases(asked: DataFrame) -> DataFrame:
    """class, digest, alias and batch for each (class, digest, batch) of a stream.

    State is one list for all digests of a class whose encodings share their first characters. An
    alias in it never changes; digests that come together there all get aliases long enough to tell
    them from each other and from those before.
    """
    codes = asked.select("class", "digest", "batch", encode_digest("digest").alias("code"))
    keyed = codes.withColumn("near", F.substring("code", 1, CODE))
    email, suffix, first, step = X.EMAIL, X.EMAIL_SUFFIX, CODE, STEP

    def apart(a: str, b: str) -> int:
        """Shortest allowed length at which two encodings differ."""
        return next((n for n in range(first, len(a) + 1, step) if a[:n] != b[:n]), first)

    class Book(StatefulProcessor):
        def init(self, handle) -> None:
            self.known = handle.getValueState("known", "entries map<string,string>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            asked = {(r.code, r.digest, r.batch) for r in rows}
            known = dict(self.known.get()[0]) if self.known.exists() else {}  # encoding to alias
            codes = sorted(known.keys() | {c for c, _, _ in asked})
            fresh = {}
            for i, code in enumerate(codes):
                if code not in known:
                    length = max([first, *(apart(code, other) for other in codes[max(0, i - 1) : i] + codes[i + 1 : i + 2])])
                    fresh[code] = f"user_{code[:length]}{suffix if key[0] == email else ''}"
            if fresh:
                known |= fresh
                self.known.update((known,))
            for code, digest, batch in sorted(asked):
                yield Row(**{"class": key[0]}, digest=digest, alias=known[code], batch=batch)

        def close(self) -> None: ...

    return keyed.groupBy("class", "near").transformWithState(Book(), "class string, digest string, alias string, batch long", "append", "none")


_ASKED = "class string, digest string, batch long"


def alias_state_sink(state: str, out_path: str, columns: Mapping[str, str], key: Callable[[SparkSession], Key]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that aliases columns (name to class) from keyed state.

    The digests a batch names are written down once each; a stream over those files takes them to
    their state and tells their aliases, which the rows of the batch meet in a salted join. A batch
    that comes again asks again and is told the same.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        k = key(spark)
        parts = [batch.select(F.lit(c).alias("class"), alias_digest(F.col(f"`{n}`").cast("string"), k).alias("digest")) for n, c in columns.items()]
        wanted = parts[0]
        for part in parts[1:]:
            wanted = wanted.unionByName(part)
        asked = wanted.where(F.col("digest").isNotNull()).distinct().withColumn("batch", F.lit(batch_id).cast("long"))
        asked.write.mode("overwrite").parquet(f"{state}/asked/part={batch_id}")
        told = _told(spark, state).where(F.col("batch") == batch_id).groupBy("class", "digest").agg(F.max("alias").alias("alias"))
        out = batch
        for name, cls in columns.items():
            out = salted_alias(out, name, cls, told, k)
        out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return run


def _told(spark: SparkSession, state: str) -> DataFrame:
    """Bring what is asked to its state, and all answers, by batch."""
    schema = T._parse_datatype_string(_ASKED)
    answers = register_aliases(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{state}/asked"))
    with state_on_disk(spark):
        query = (
            answers.writeStream.format("parquet").outputMode("append").partitionBy("batch")
            .option("checkpointLocation", f"{state}/book").trigger(availableNow=True).start(f"{state}/told")
        )
    query.awaitTermination()
    return spark.read.schema("class string, digest string, alias string, batch long").parquet(f"{state}/told")


def as_table(stream: DataFrame, folder: str) -> Callable[[], DataFrame]:
    """A function that takes what is new in a stream's source into a table, batch by batch, and
    reads the table. A batch that comes again overwrites its part."""

    def take(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    def run() -> DataFrame:
        spark = stream.sparkSession
        with state_on_disk(spark):
            query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(take).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    return run
