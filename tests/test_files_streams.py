"""Sources, sinks, managed files, bundles and streams."""

import json

import pytest
from pyspark.sql import functions as F

from checks import base, selects
from tableguard.functions.keyed import key_table, table_key
from tableguard.operators import bundle as B, corpus as CO, index as I, protect as P
from tableguard.session import cut_lineage, shared_folder
from tableguard.sources import catalog as SC, tables as ST
from tableguard.sources.rules import make_rules
from tableguard.streaming import streams as SS
from tests.test_catalog_graph import ENTRY, SCHEMA, entries

SF = "/root/testdata/sf0.001"


def test_lake_catalog(spark):
    got = SC.read_lake_catalog(spark, SF)
    assert got["objects"].count() == 14 and got["columns"].where("table_name = 'customer'").count() == 5
    row = got["columns"].where("column_name = 'embedding'").first()
    assert row.object_id == "table:sf0.001.embeddings" and row.data_type == "array<float>"


def test_jdbc_catalog_and_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).selectExpr("cast(id as int) as id", "concat('n', id) as name")
    rows.write.format("jdbc").options(url=url, dbtable="PEOPLE", **options).save()
    got = SC.read_catalog_jdbc(spark, url, "derby", ["APP"], options)
    assert [r.object_id for r in got["objects"].collect()] == ["table:APP.PEOPLE"]
    assert {r.column_name: r.ordinal for r in got["columns"].collect()} == {"id": 1, "name": 2}
    assert got["indexes"].count() == 0
    whole = ST.read_table_all(spark, url, "PEOPLE", key='"id"', partitions=4, options=options)
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 1000 and whole.agg(F.sum("id")).first()[0] == 499500


@pytest.mark.parametrize("engine", [e for e in SC.QUERIES if e != "derby"])
def test_catalog_queries_name_their_columns(engine):
    for kind in SC.KINDS:
        text = SC.catalog_query(engine, kind, ["a'b", "c"])
        assert "'a''b', 'c'" in text
        first = [c.split()[0] for c in SC._SCHEMAS[kind].split(", ")]
        assert all(name in text for name in first), (kind, first)


def test_routine_definitions_join_their_lines(spark):
    rows = spark.createDataFrame([("a", "P", "procedure", 2, "begin null; end;"), ("a", "P", "procedure", 1, "procedure P as\n"), ("a", "F", "FN", 1, "f"), ("a", "X", "trigger", 1, "t")], SC._SCHEMAS["definitions"])
    got = {r.object_id: r.definition for r in SC._normal("definitions", rows).collect()}
    assert got == {"procedure:a.P": "procedure P as\nbegin null; end;", "function:a.F": "f"}


def test_index_parts_hold_only_what_a_batch_names(spark, tmp_path):
    """A batch writes the rows of its own identities; reading and compacting give the whole index."""
    sink = SS.index_sink(str(tmp_path / "a"))
    sink(entries(spark, *[dict(object_name=f"T{i}") for i in range(50)]), 0)
    sink(entries(spark, dict(object_name="T7", description="changed"), dict(object_name="NEW")), 1)
    parts = spark.read.parquet(str(tmp_path / "a" / "index"))
    assert {r["batch"]: r["count"] for r in parts.groupBy("batch").count().collect()} == {0: 50, 1: 2}
    now = SS.read_index(spark, str(tmp_path / "a"))
    assert now.count() == 51 and now.where("description = 'changed'").count() == 1
    SS.compact_index(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert SS.read_index(spark, str(tmp_path / "b")).exceptAll(now).count() == 0
    SS.index_sink(str(tmp_path / "b"))(entries(spark, dict(object_name="LATER")), 2)
    assert SS.read_index(spark, str(tmp_path / "b")).count() == 52


def test_corpus_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+y.sql").write_bytes("﻿create table t (a int)".encode())
    (tmp_path / "n.txt").write_text("no")
    (tmp_path / "latin.sql").write_bytes("-- café".encode("latin-1"))
    files = ST.read_sql_corpus(spark, str(tmp_path))
    assert files.columns == ["path", "content", "problem"]
    got = {r.path: (r.content, r.problem) for r in files.collect()}
    assert got == {"a b/x+y.sql": ("create table t (a int)", None), "latin.sql": (None, ST.NOT_UTF8)}


def test_sinks(spark, key, tmp_path):
    rows = spark.createDataFrame([("Ann", "0812345678", None)], "first_name string, tel string, b int")
    masked = P.protect(rows, None, key)
    ST.write_sample(masked, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first()[0] == "first_name ⟨FAKE:PERSONAL_NAME⟩,tel ⟨FAKE:PHONE⟩,b"
    ST.write_sample(masked, str(tmp_path / "json"), "json")
    with pytest.raises(ValueError):
        ST.write_sample(spark.range(21), str(tmp_path / "many"))
    line = spark.read.text(str(tmp_path / "json")).first()[0]
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":")) and list(json.loads(line)) == ["b", "first_name", "tel"]
    files = spark.createDataFrame([("a", "é"), ("b", "")], "path string, content string")
    ST.write_manifest(files, str(tmp_path / "m"))
    assert {r.path: r.size_bytes for r in ST.read_manifest(spark, str(tmp_path / "m")).collect()} == {"a": 2, "b": 0}
    objs = spark.createDataFrame([("table:a.T", "table", None), ("function:a.F", "function", "um")], "object_id string, object_type string, category string")
    ST.materialize(objs, str(tmp_path / "out"))
    assert {(r.category, r.folder) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("unknowns", "tables"), ("um", "functions")}
    assert spark.read.parquet(ST.write_index(objs, str(tmp_path / "idx"), 3)).count() == 2


def test_headers_round_trip(spark):
    rows = entries(spark, dict(description='say "hi"\\', evidence=["ev_1"]))
    full = rows.withColumn("object_id", F.lit("table:app.A")).withColumn("engine", F.lit("postgres")).withColumn("body", F.lit("create table app.A (x int)\n"))
    full = full.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("body", 256)))
    text = CO.render_header(full).select(F.lit("p").alias("path"), "content")
    line = text.first().content.split("\n")[0].removeprefix(CO.DEFAULT_PREFIX)
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    back = CO.parse_header(text).first()
    assert back.state == "ok" and back.header.description == 'say "hi"\\' and back.body == "create table app.A (x int)\n"
    assert CO.check_identity(text, "postgres").first().problem is None
    assert CO.check_identity(text, "mysql").first().problem == "MANAGED_SQL_ENGINE_MISMATCH"
    for bad in ("{}", "{not", '{"object_id": 1, "zz": 2}'):
        broken = spark.createDataFrame([(f"{CO.DEFAULT_PREFIX}{bad}\nx",)], "content string")
        assert CO.parse_header(broken).first().state == "invalid"
    assert CO.parse_header(spark.createDataFrame([("create table t",)], "content string")).first().state == "missing"
    corpus = CO.parse_header(text.withColumn("path", F.lit("um/tables/A.sql")))
    same = full.withColumn("active", F.lit(True))
    assert I.generation_plan(same, corpus).first().drift is None
    assert I.generation_plan(same.withColumn("context", F.lit("zz")), corpus).first().drift == "header_differs"
    assert I.plan_hash(I.generation_plan(same, corpus)).first().items == 1


SQL = {
    "create table a.b (x int)": ("table", "a", "b"),
    "/* create table z /* alter proc y */ */ ALTER  PROC [my]]s] . [p q] as": ("procedure", "my]s", "p q"),
    "-- create table z\ncreate or alter function f() 'create table y' \"create table x\"": ("function", "dbo", "f"),
    "select 'it''s create table t'": None,
    "create table a (x int); create table b (x int)": None,
    "create/**/table/**/t1 (a int)": ("table", "dbo", "t1"),
    "create table [a--b] (x int) /* unclosed create table q": ("table", "dbo", "a--b"),
    "recreate table t": None,
}


def test_declarations(spark):
    rows = spark.createDataFrame([(s,) for s in SQL], "s string")
    got = {r.s: (r.declared_type, r.declared_schema, r.declared_name) if r.declarations == 1 else None for r in CO.detect_identity(rows, "s").collect()}
    assert got == SQL


def test_folder_plan_and_drift(spark):
    rules = make_rules([dict(name="um", description="users", prefixes=["UM_"]), dict(name="x", schemas=["zz"])])
    files = [("a/UM_A.sql", "create table app.UM_A (x int)"), ("b/Q.sql", "create table app.Q (x int)"), ("c/W.sql", "create table app.W (x int)"), ("d/w.sql", "create table zz.UM_W (x int)")]
    corpus = spark.createDataFrame(files, "path string, content string")
    fix = spark.createDataFrame([("B/q.sql", "um", None, ["z", "a"])], "path string, context string, description string, tags array<string>")
    plan = CO.folder_plan(corpus, rules, "postgres", fix)
    rows = {r.path: r for r in plan.collect()}
    assert rows["a/UM_A.sql"].destination == "um/tables/UM_A.sql" and rows["a/UM_A.sql"].evidence == ["rule:configured_prefix:um"]
    assert (rows["b/Q.sql"].destination, rows["b/Q.sql"].tags, rows["b/Q.sql"].header.classification_source) == ("um/tables/Q.sql", ["a", "z"], "owner")
    assert rows["c/W.sql"].problem == rows["d/w.sql"].problem == "FOLDER_DESTINATION_COLLISION"
    assert CO.unused_resolutions(corpus, fix).count() == 0 and CO.input_drift(plan, corpus).count() == 0
    assert CO.input_drift(plan, corpus.withColumn("content", F.concat("content", F.lit(" ")))).count() == 4
    good = plan.where("problem is null")
    placed = good.select(F.col("destination").alias("path"), F.col("rendered").alias("content"))
    manifest = good.select(F.col("destination").alias("path"), F.col("output_hash").alias("sha256"))
    assert CO.corpus_drift(good, placed, manifest).count() == 0
    assert {r.reason for r in CO.corpus_drift(good, placed, manifest.limit(0)).collect()} == {"not_in_manifest"}
    old = spark.createDataFrame([("a/UM_A.sql", "x"), ("other", "y")], "path string, sha256 string")
    after = CO.replace_in_manifest(old, good)
    assert {r.path for r in after.collect()} == {"other", "um/tables/UM_A.sql", "um/tables/Q.sql"}
    assert CO.manifest_hash(after).first() == CO.manifest_hash(after.repartition(3).orderBy("sha256")).first()
    again = CO.folder_plan(spark.createDataFrame([("UM_A.sql", files[0][1]), ("e/UM_A.sql", files[0][1])], "path string, content string"), rules, "postgres")
    assert {r.problem for r in again.collect()} == {"FOLDER_DUPLICATE_OBJECT_IDENTITY"}
    in_place = spark.createDataFrame([("um/tables/UM_B.sql", "create table app.ZZ (x int)"), ("k/UM_B.sql", "create table app.UM_B (x int)")], "path string, content string")
    problems = {r.path: r.problem for r in CO.folder_plan(in_place, rules, "postgres", in_place=True).collect()}
    assert problems["k/UM_B.sql"] == "FOLDER_IN_PLACE_SOURCE_COLLISION"


def test_folder_plan_stores_keys_and_no_text(spark, monkeypatch):
    rules = make_rules([dict(name="um", description="users", prefixes=["UM_"])])
    files = [(f"{i}/T{i % 7}.sql", f"create table app.T{i} (x int)") for i in range(40)] + [("z/a.sql", None), ("z/b.sql", "")]
    corpus = spark.createDataFrame(files, "path string, content string")
    stored = []
    cut = CO.cut_lineage
    monkeypatch.setattr(CO, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    few = {r.path: r for r in CO.folder_plan(corpus, rules, "postgres").collect()}
    assert stored == [["path", "id_key", "dest_key", "problem"], ["__tg_path", "__tg_id_key", "__tg_dest_key", "__tg_clash"]]
    monkeypatch.setattr(CO, "CLASHES", 0)  # joined by a shuffle
    many = {r.path: r for r in CO.folder_plan(corpus, rules, "postgres").collect()}
    assert few == many and len(few) == 42
    assert {r.problem for p, r in few.items() if not p.startswith("z/")} == {"FOLDER_DESTINATION_COLLISION"}
    assert CO.folder_plan(corpus.limit(0), rules, "postgres").count() == 0


def test_index_rows_without_path_do_not_meet(spark):
    rows = entries(spark, {}).withColumn("active", F.lit(True)).drop("managed_relative_path").crossJoin(spark.range(1000)).drop("id")
    rows = rows.withColumn("managed_relative_path", F.lit(None).cast("string"))
    corpus = CO.parse_header(spark.createDataFrame([(None, "x"), ("um/A.sql", "y")], "path string, content string"))
    got = I.generation_plan(rows, corpus, include_unresolved=True).groupBy("drift").count().collect()
    assert [(r.drift, r["count"]) for r in got] == [("path_or_hash_missing", 1000)]


def test_assembly_is_stable_and_reconciles(spark):
    def inv(batch, *paths):
        return [(batch, p, 1, f"sha256:{p}", "full") for p in paths]

    files = spark.createDataFrame(inv("b1", "a", "b", "manifest.yaml") + inv("b2", "b", "c") + inv("b3", "b", "c"), "batch string, path string, size_bytes long, sha256 string, output_profile string")
    merged, conflicts = B.assemble(files)
    assert sorted(r.path for r in merged.collect()) == ["a", "b", "c"] and conflicts.count() == 0
    assert B.distinct_bundles(files).count() == 2
    assert B.inventory_hash(merged).first() == B.inventory_hash(B.assemble(files)[0].repartition(5)).first()
    extra = [(p, 1, "r") for p in B.REPORTS["full"]]
    submitted = merged.unionByName(spark.createDataFrame(extra, "path string, size_bytes long, sha256 string"))
    status = spark.createDataFrame([(3, 3, 2, 1)], "discovered long, analysed long, materialised long, excluded long")
    expected = dict(version="2", discovered=3, analysed=3, materialised=2)
    declared = files.withColumn("output_format_version", F.lit("2"))
    row = B.reconcile(declared, submitted, status, expected).first()
    assert row.valid and row.errors == ""
    row = B.reconcile(declared, submitted.where("path <> 'a'"), status, expected | dict(materialised=9)).first()
    assert row.errors == "assembled_inventory_mismatch,materialized_count_mismatch"


# Streams --------------------------------------------------------------------------------------------


def drain(stream, folder, write, mode="append"):
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


@pytest.mark.parametrize("name, batch", [("audit_windows_stream", "audit_windows")])
def test_stream_equals_batch(spark, name, batch):
    a, b = (base.QUERIES[n](spark, SF) for n in (name, batch))
    cast = [F.col(c).cast("string") for c in sorted(a.columns)]
    assert a.select(cast).exceptAll(b.select(cast)).count() == 0 and a.count() == b.count()
    assert selects is not None


def test_protected_stream_equals_batch(spark, key, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(200).selectExpr("id", "concat('u', id % 9) as login", "concat('call 08123456', lpad(id % 90, 2, '0')) as remark")
    rows.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    drain(SS.protect_stream(stream, None, key), tmp_path / "c", lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    got, want = spark.read.parquet(out).drop("batch"), P.protect(rows, None, key)
    assert got.exceptAll(want).count() == 0 and got.count() == 200


def test_alias_sink_replays(spark, tmp_path):
    reg, out = str(tmp_path / "reg"), str(tmp_path / "out")
    sink = SS.alias_sink(reg, out, {"who": "username"}, lambda s: table_key(key_table(s, b"k")))
    one = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, None)], "id int, who string")
    two = spark.createDataFrame([(4, "ann"), (5, "cy")], "id int, who string")
    for df, i in ((one, 0), (two, 1), (two, 1), (one, 0)):
        sink(df, i)
    rows = {r.id: r.who for r in spark.read.parquet(out).collect()}
    assert rows[1] == rows[4] and rows[3] is None and len(set(rows.values())) == 4
    assert spark.read.parquet(reg).count() == 3


def test_index_sink_replays_and_conflicts(spark, tmp_path):
    sink = SS.index_sink(str(tmp_path))
    sink(entries(spark, {}, dict(object_name="B")), 0)
    sink(entries(spark, dict(description="new"), dict(object_name="C")), 1)
    sink(entries(spark, dict(description="new"), dict(object_name="C")), 1)
    now = SS.read_index(spark, str(tmp_path))
    assert {(r.object_name, r.description) for r in now.collect()} == {("A", "new"), ("B", "d"), ("C", "d")}
    with pytest.raises(SS.BatchConflict):
        sink(entries(spark, dict(description="other")), 1)
    assert list(ENTRY) == [c.split()[0] for c in SCHEMA.split(", ")]


def test_drift_alarm(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,id) as occurred_at, if(id = 2, 'a@b.co', 'x') as code, '0812345678' as phone from range(4)")
    got = SS.drift_alarm(rows, None).collect()
    assert [(r.column_name, r["class"], r.n) for r in got] == [("code", "email", 1)]


def test_shared_folder(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder == shared_folder(spark)
    assert cut_lineage(spark.range(5)).count() == 5
