"""Streams with keyed state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableguard.functions.keyed import key_table, table_key
from tableguard.operators import aliases as A
from tableguard.streaming import bucketed as BK, stateful as SF, streams as SS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "occurred_at timestamp, code string"


def hour(h, code):
    return (T0 + dt.timedelta(hours=h), code)


class Source:
    """A folder that parts come into."""

    def __init__(self, spark, folder, schema=SCHEMA):
        self.spark, self.path, self.schema = spark, f"{folder}/in", schema
        spark.createDataFrame([], schema).write.parquet(self.path)
        self.stream = spark.readStream.schema(schema).parquet(self.path)

    def bring(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).write.mode("append").parquet(self.path)


def told(table):
    return sorted((r.column_name, r["class"], r.window_start, r.n) for r in table.collect())


def test_a_class_is_told_once_over_batches_late_rows_and_restarts(spark, tmp_path):
    source = Source(spark, tmp_path)
    take = SF.as_table(SF.new_classes(source.stream, None), str(tmp_path))
    source.bring(hour(0, "a@b.co"), hour(0, "c@d.co"), hour(0, "plain"), hour(0, None))
    assert told(take()) == []  # the window is open
    source.bring(hour(2, "a@b.co"))
    first = [("code", "email", T0, 2)]
    assert told(take()) == first
    source.bring(hour(0.5, "0812345678"), hour(3, "x@y.co"), hour(3, "0812345678"))  # the first is late
    source.bring(hour(9, "plain"))
    both = [*first, ("code", "phone", T0 + dt.timedelta(hours=3), 1)]
    assert told(take()) == both
    again = SF.as_table(SF.new_classes(source.stream, None), str(tmp_path))  # goes on from its state
    source.bring(hour(12, "a@b.co"), hour(12, "0812345678"), hour(20, "plain"))
    assert told(again()) == both


def test_a_class_that_was_forgotten_is_new(spark, tmp_path):
    source = Source(spark, tmp_path)
    take = SF.as_table(SF.new_classes(source.stream, None, forget_after=6 * 3600), str(tmp_path))
    for h in (0, 4, 8, 30, 60):
        source.bring(hour(h, "a@b.co" if h < 60 else "plain"))
        table = take()
    assert [r[2] for r in told(table)] == [T0, T0 + dt.timedelta(hours=30)]


def test_a_declared_class_is_no_surprise(spark, tmp_path):
    source = Source(spark, tmp_path)
    take = SF.as_table(SF.new_classes(source.stream, {"code": "email"}), str(tmp_path))
    source.bring(hour(0, "a@b.co"), hour(0, "0812345678"))
    take()
    source.bring(hour(5, "plain"))
    assert told(take()) == [("code", "phone", T0, 1)]


DIGESTS = ["0" * 64, "0" * 13 + "8" + "0" * 50, "0" * 16 + "1" + "0" * 47, "f" * 64, "f" * 30 + "0" * 34]


def test_aliases_of_state_equal_the_registry_batch_by_batch(spark, tmp_path):
    """Digests made up so that their first characters collide; every order of arrival."""
    rows = lambda names, batch: spark.createDataFrame([(c, d, batch) for c, d in names], "class string, digest string, batch long")
    batches = [[("username", DIGESTS[0]), ("email", DIGESTS[3])], [("username", d) for d in DIGESTS[:3]], [("username", d) for d in DIGESTS] + [("email", d) for d in DIGESTS]]
    registry = spark.createDataFrame([], "class string, digest string, alias string")
    for i, names in enumerate(batches):
        fresh = A.register(rows(names, 0).select("class", "digest"), registry).collect()
        registry = spark.createDataFrame(registry.collect() + fresh, registry.schema)
        rows(names, i).write.parquet(f"{tmp_path}/asked/part={i}")
        answers = {(r["class"], r.digest): r.alias for r in SF._told(spark, str(tmp_path)).where(f"batch = {i}").collect()}
        known = {(r["class"], r.digest): r.alias for r in registry.collect()}
        assert answers == {k: known[k] for k in names}
    assert len(set(known.values())) == len(known) and max(map(len, known.values())) > 15


def test_alias_sink_replays_and_touches_what_it_is_asked(spark, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    sink = SF.alias_state_sink(state, out, {"who": "username", "boss": "username"}, lambda s: table_key(key_table(s, b"k")))
    schema = "id int, who string, boss string"
    one = spark.createDataFrame([(1, "ann", "bob"), (2, "bob", None), (3, None, "ann")], schema)
    two = spark.createDataFrame([(4, "ann", "ann"), (5, "cy", "cy")] + [(10 + i, "hot", "hot") for i in range(50)], schema)
    for df, i in ((one, 0), (two, 1), (two, 1), (one, 0)):
        sink(df, i)
    rows = {r.id: r for r in spark.read.parquet(out).collect()}
    assert len(rows) == 55 and rows[1].who == rows[4].who == rows[3].boss and rows[3].who is None and rows[2].boss is None
    assert len({r.who for r in rows.values()} - {None}) == 4
    asked = spark.read.parquet(f"{state}/asked").groupBy("batch").count()
    assert {r["batch"]: r["count"] for r in asked.collect()} == {0: 2, 1: 3}


def test_hot_value_is_dealt_to_many_tasks(spark, key):
    """Nine tenths of the rows hold one name; without adaptive splitting they still spread."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000, numPartitions=16).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("who"))
        none = spark.createDataFrame([], "class string, digest string, alias string")
        registry = A.alias_registry(rows.select(F.lit("username").alias("class"), F.col("who").alias("value")), none, key)
        out = A.apply_aliases(rows, "who", "username", registry, key)
        sizes = [r["count"] for r in out.where("id % 10 > 0").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3600 and max(sizes) < 2000 and out.where("who is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def index_rows(spark, names, context, source="rule"):
    schema = "schema_name string, object_name string, object_type string, context string, description string, tags array<string>, classification_status string, classification_source string, source_fingerprint string, content_hash string, managed_relative_path string, header_version int, output_format_version string, evidence array<string>"
    rows = [("s", n, "table", context, "d", [], None, source, f"f{context}", None, None, 1, "2", []) for n in names]
    return spark.createDataFrame(rows, schema)


def test_a_batch_reads_its_buckets_and_compacts_them(spark, tmp_path):
    root = str(tmp_path / "index")
    sink = BK.bucketed_sink(root, buckets=256, most_parts=2)
    sink(index_rows(spark, [f"n{i}" for i in range(400)], "a"), 0)
    ten = [f"n{i}" for i in range(10)]
    parts = BK.parts_of(spark, root, index_rows(spark, ten, "b"), 256)
    assert 1 <= len({b for b, _ in parts}) <= 10
    schema = spark.read.parquet(f"{root}/schema").schema
    read = {f.split("bucket=")[1].split("/")[0] for f in BK._rows(spark, root, parts, schema).inputFiles()}
    assert read == {str(b) for b, _ in parts}
    for batch_id, context in ((1, "b"), (2, "c"), (3, "d")):
        sink(index_rows(spark, ten, context, "owner" if context == "c" else "rule"), batch_id)
    now = {r.object_name: (r.context, r.source_fingerprint) for r in BK.read_bucketed(spark, root).collect()}
    assert len(now) == 400 and now["n3"] == ("c", "fd") and now["n300"] == ("a", "fa")
    before = {r.object_name: r.context for r in BK.read_bucketed(spark, root, version=1).collect()}
    assert before["n3"] == "b" and len(before) == 400
    held = BK._manifest(spark, root, 3)[0]
    assert max(sum(b == x for b, _ in held) for x, _ in held) <= 2
    assert BK.vacuum(spark, root) > 0 and BK.read_bucketed(spark, root).count() == 400


def test_replays_conflicts_and_unfinished_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    sink = BK.bucketed_sink(root, buckets=8)
    with pytest.raises(ValueError):
        BK.read_bucketed(spark, root)
    one = index_rows(spark, ["x", "y"], "a")
    sink(one, 4)
    sink(one.repartition(3), 4)
    for rows, batch_id in ((index_rows(spark, ["x"], "a"), 4), (one, 2)):
        with pytest.raises(SS.BatchConflict):
            sink(rows, batch_id)
    # A version without its mark is not there.
    index_rows(spark, ["z"], "q").selectExpr("1 as bucket", "9L as batch", "'d' as digest").write.parquet(f"{root}/manifest/version=9")
    (tmp_path / "index" / "manifest" / "version=9" / "_SUCCESS").unlink()
    assert BK.read_bucketed(spark, root).count() == 2
    sink(one.limit(0), 9)  # an empty batch is a version as well
    assert BK.read_bucketed(spark, root).count() == 2 and BK._versions(spark, root) == [4, 9]
