"""Catalog, classification, graph and index on small hand-made inventories."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableguard.functions.allowed import ALLOWED, call, register
from tableguard.operators import catalog as C, graph as G, index as I, objects as O
from tableguard.operators.spread import spread_left_join
from tableguard.sources.rules import make_rules, read_rules

RULES = make_rules(
    [
        dict(name="lut", prefixes=["LUT_"]),
        dict(name="um", exact_names=["UM_USER"], prefixes=["UM_"], column_keywords=["username", "role_id"]),
        dict(name="content", exact_names=["CONTENT"], prefixes=["CONTENT_"], column_keywords=["content_id"]),
    ]
)
NAMES = [
    ("table", "UM_USER"), ("table", "UM_ROLE"), ("table", "CONTENT"), ("table", "CONTENT_SHARE"),
    ("procedure", "UM_USER_I"), ("procedure", "CONTENT_I"), ("table", "LEGACY_X"),
]


@pytest.fixture(scope="module")
def objects(spark):
    rows = [(f"{k}:app.{n}", "app", n, k, None, "f" + n) for k, n in NAMES]
    return spark.createDataFrame(rows, "object_id string, schema_name string, object_name string, object_type string, native_comment string, source_fingerprint string")


@pytest.fixture(scope="module")
def columns(spark):
    parts = {
        "UM_USER": "USER_ID USERNAME ROLE_ID", "UM_ROLE": "ROLE_ID ROLE_NAME", "CONTENT": "CONTENT_ID TITLE OWNER_USER_ID",
        "CONTENT_SHARE": "CONTENT_ID USER_ID",
    }
    rows = [(f"table:app.{t}", c, "int", i) for t, cs in parts.items() for i, c in enumerate(cs.split(), 1)]
    return spark.createDataFrame(rows, "object_id string, column_name string, data_type string, ordinal int")


@pytest.fixture(scope="module")
def keys(spark):
    fk = [
        ("FK1", "UM_USER", "UM_ROLE", ["ROLE_ID"], ["ROLE_ID"]), ("FK2", "CONTENT", "UM_USER", ["OWNER_USER_ID"], ["USER_ID"]),
        ("FK3", "CONTENT_SHARE", "CONTENT", ["CONTENT_ID"], ["CONTENT_ID"]), ("FK4", "CONTENT_SHARE", "UM_USER", ["USER_ID"], ["USER_ID"]),
        ("FK5", "CONTENT", "GONE", ["CONTENT_ID"], ["ID"]),
    ]
    fks = spark.createDataFrame([(n, f"table:app.{s}", f"table:app.{t}", a, b) for n, s, t, a, b in fk],
                                "name string, source_object_id string, target_object_id string, source_columns array<string>, target_columns array<string>")
    pk = [("UM_USER", ["USER_ID"]), ("UM_ROLE", ["ROLE_ID"]), ("CONTENT", ["content_id"]), ("CONTENT_SHARE", ["USER_ID", "CONTENT_ID"])]
    cons = spark.createDataFrame([(f"table:app.{t}", "PK_" + t, "primary_key", c) for t, c in pk], "object_id string, constraint_name string, constraint_type string, columns array<string>")
    return fks, cons


@pytest.fixture(scope="module")
def deps(spark):
    rows = [("procedure:app.UM_USER_I", "table:app.UM_USER", "routine_write"), ("procedure:app.CONTENT_I", "table:app.CONTENT", "routine_write")]
    return spark.createDataFrame(rows, "source_object_id string, target_object_id string, edge_type string")


@pytest.fixture(scope="module")
def final(objects, columns, keys, deps):
    edges = deps.unionByName(G.fk_edges(keys[0]).drop("evidence"))
    return O.pass2(objects, O.pass1(objects, RULES), RULES, columns, edges)


def test_golden_classification(final):
    got = {r.object_id.split(".")[1]: (r.category, r.status) for r in final.collect()}
    assert got["UM_USER"] == ("um", "final_confirmed") and got["CONTENT_SHARE"] == ("content", "final_confirmed")
    assert got["LEGACY_X"] == (None, "final_unresolved")


def test_golden_counts(spark, objects, final):
    plan = C.plan(objects, final, "selected", ["um", "content"])
    none = spark.createDataFrame([], "object_id string, stage string, error_code string")
    row = C.status(objects, none, plan).first()
    assert (row.discovered, row.analysed, row.failed, row.materialised, row.excluded) == (7, 7, 0, 6, 1)
    reasons = {r.object_id: r.reason for r in plan.collect()}
    assert reasons["table:app.UM_USER"] == "selected_category" and reasons["table:app.LEGACY_X"] == "intentionally_excluded"


def test_golden_relationships(objects, keys, final):
    plan = C.plan(objects, final, "selected", ["um"])
    rows = {r.name: r for r in G.relationships(*keys, objects, plan).collect()}
    assert {n: r.cardinality for n, r in rows.items()} == {"FK1": "1:N", "FK2": "1:N", "FK3": "M:N", "FK4": "M:N", "FK5": "1:1"}
    assert rows["FK5"].confidence == "unknown" and rows["FK1"].confidence == "confirmed"
    assert {n: r.boundary_only for n, r in rows.items()} == {"FK1": False, "FK2": True, "FK3": False, "FK4": True, "FK5": False}


def test_golden_graph(objects, columns, keys, deps, final):
    plan = C.plan(objects, final, "all")
    nodes = G.nodes(objects, columns, final, plan, "db")
    assert nodes.count() == nodes.select("id").distinct().count() == 1 + 1 + 2 + 7 + 10
    edges = G.edges(objects, columns, keys[1], final, keys[0], deps, plan, "db")
    by_type = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert by_type == {"CONTAINS": 8, "BELONGS_TO_CATEGORY": 6, "HAS_COLUMN": 10, "PRIMARY_KEY": 4, "FOREIGN_KEY": 5, "WRITES_TO": 2}


def test_two_authoritative_categories_stay_open_and_close_suggestions_too(spark):
    rules = make_rules([dict(name="a", prefixes=["X_"]), dict(name="b", schemas=["s"]), dict(name="c", comment_keywords=["hello"])])
    rows = [("1", "s", "X_A", None), ("2", "t", "X_B", "hello"), ("3", "t", "Y", "hello"), ("4", "t", "Y", None)]
    objs = spark.createDataFrame([(i, s, n, "table", c) for i, s, n, c in rows], "object_id string, schema_name string, object_name string, object_type string, native_comment string")
    got = {r.object_id: (r.category, r.status) for r in O.pick(O.pass1_matches(objs, rules), True).collect()}
    assert got == {"1": (None, "final_unresolved"), "2": ("a", "final_confirmed"), "3": ("c", "final_suggested")}
    first = {r.object_id: r.category for r in O.pass1(objs, rules).collect()}
    assert first == {"1": None, "2": "a", "3": "c", "4": None}  # 0.98 and 0.95 are too close


def test_hub_object_needs_one_row_per_neighbour(spark):
    """Agreement over a hub is a minimum and a maximum, whatever its number of edges."""
    edges = spark.range(20000).selectExpr("'hub' as source_object_id", "concat('n', id % 500) as target_object_id", "'foreign_key' as edge_type")
    first = spark.range(500).selectExpr("concat('n', id) as object_id", "'um' as category")
    got = {r.object_id: r.kind for r in O.neighbour_vote(edges, first).collect()}
    assert got == {"hub": "foreign_key_neighborhood"}
    mixed = first.withColumn("category", F.when(F.col("object_id") == "n7", "x").otherwise(F.col("category")))
    assert O.neighbour_vote(edges, mixed).count() == 0


def busiest(df):
    """Share of the rows that the fullest partition holds."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def test_hot_keys_meet_their_facts_in_many_tasks(spark):
    """Nine tenths of the rows share a key, another part has none; no help from adaptive splitting."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(20000).selectExpr("id", "case when id % 20 < 18 then 'hub' when id % 20 = 18 then null else concat('n', id) end as k")
        facts = spark.range(20000).selectExpr("concat('n', id) as k", "id as fact").unionByName(spark.createDataFrame([("hub", -1)], "k string, fact long"))
        plain, spread = rows.join(facts, "k", "left"), spread_left_join(rows, facts, "k")
        assert spread.select("id", "k", "fact").exceptAll(plain.select("id", "k", "fact")).count() == 0 and spread.count() == 20000
        assert busiest(plain) > 0.85 and busiest(spread) < 0.5
        edges = spark.range(20000).selectExpr("concat('n', id) as source", "if(id % 10 = 0, concat('n', id), 'hub') as target")
        plan = spark.createDataFrame([("hub", True), ("n7", True), ("n9", False)], "object_id string, included boolean")
        flagged = G.boundary(edges, plan)
        assert busiest(flagged) < 0.5
        assert flagged.where("boundary_only").count() == 18000 - 1  # n7 is inside as well
        same = flagged.where("source = 'n7'").first()
        assert not same.boundary_only and G.boundary(edges.limit(0), plan).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rules_are_checked(tmp_path):
    with pytest.raises(ValueError):
        make_rules([dict(name="Bad Name")])
    with pytest.raises(ValueError):
        make_rules([dict(name="a", other=[])])
    with pytest.raises(ValueError):
        make_rules([dict(name="a")], {"x": "b"})
    (tmp_path / "r.json").write_text('{"version": 1, "categories": [{"name": "a", "prefixes": ["A_"]}]}')
    (tmp_path / "o.json").write_text('{"version": 1, "overrides": {"table:s.T": "a"}}')
    rules = read_rules(tmp_path / "r.json", tmp_path / "o.json")
    assert rules.names == ["a"] and rules.overrides == {"table:s.T": "a"}


def test_diff_and_reuse(spark):
    schema = "object_id string, object_type string, fingerprint string, definition string, sample string, dependencies string"
    before = spark.createDataFrame([("T", "table", "1", "d", "s", "e"), ("K", "table", "1", "d", "s", "e"), ("P", "procedure", "1", "d", "s", "e"), ("DELETED", "table", "1", "d", "s", "e")], schema)
    after = spark.createDataFrame([("T", "table", "2"), ("K", "table", "1"), ("P", "procedure", "1"), ("ADDED", "table", "1")], "object_id string, object_type string, fingerprint string")
    assert C.diff_summary(C.diff(before, after)).first().asDict() == dict(added=1, changed=1, deleted=1, reused=2, complete=True)
    none = after.withColumn("fingerprint", F.lit(None).cast("string"))
    assert C.diff_summary(C.diff(before, none)).first().asDict() == dict(added=1, changed=0, deleted=1, reused=0, complete=False)
    kept = {r.object_id: r for r in C.carry_forward(before, after).collect()}
    assert (kept["K"].definition, kept["K"].sample) == ("d", None) and (kept["P"].sample, kept["P"].dependencies) == ("s", "e")
    assert not kept["T"].reused and kept["T"].definition is None


def test_samples(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert C.sampling_order(["a", "b"]) == (["a"], False) and C.sampling_order(["a"], None, ["u"]) == (["u"], True)
    assert [r.k for r in C.sample(rows, 10, primary=["k"]).collect()] == list(range(10))
    for n in (9, 21):
        with pytest.raises(ValueError):
            C.sample(rows, n)
    assert C.sample_status(rows.limit(5), 10, True).first().shortage_reason == "source_returned_fewer_rows"
    with pytest.raises(ValueError):
        C.page(rows, "k", limit=251)


def test_lookup_tables_are_read_whole(spark, key):
    plan = spark.createDataFrame([("table:a.L", "table", "lut"), ("table:a.M", "table", "um")], "object_id string, object_type string, final_category string")
    got = C.lookup_snapshot(plan, lambda i: spark.range(15).selectExpr("id", "concat('a', id, '@b.co') as email"), {}, key)
    assert list(got) == ["table:a.L"] and got["table:a.L"].count() == 15
    assert got["table:a.L"].where("email not like 'user_%@example.invalid'").count() == 0


def test_lookup_tables_of_one_layout_are_read_together(spark, key):
    plan = spark.createDataFrame([(f"table:a.L{i}", "table", "lut") for i in range(6)] + [("table:a.M", "table", "um")], "object_id string, object_type string, final_category string")
    shapes = [(f"table:a.L{i}", k, c, "string") for i in range(5) for k, c in enumerate(("id", "email"))] + [("table:a.L5", 0, "code", "int"), ("table:a.M", 0, "code", "int")]
    columns = spark.createDataFrame(shapes, "object_id string, ordinal int, column_name string, data_type string")
    reads = []

    def read(ids):
        reads.append(list(ids))
        rows = spark.createDataFrame([(i,) for i in ids], "object_id string")
        return rows.selectExpr("object_id", "7 as code") if ids == ["table:a.L5"] else rows.selectExpr("object_id", "explode(array('1', null)) as id", "'a@b.co' as email")

    got = C.lookup_rows(plan, columns, read, {}, key).collect()
    assert sorted(reads) == [[f"table:a.L{i}" for i in range(5)], ["table:a.L5"]]
    assert len(got) == 11 and [r.row for r in got if r.object_id == "table:a.L5"] == ['{"code":7}']
    assert not any("a@b.co" in r.row for r in got) and sum('"id"' in r.row for r in got) == 5
    assert C.lookup_rows(plan.limit(0), columns, read, {}, key).count() == 0


def test_completeness(spark, objects, final):
    none = spark.createDataFrame([], "object_id string, stage string, error_code string")
    status = C.status(objects, none, C.plan(objects, final, "all"))
    request = dict(mode="all", schemas=["app"], allowed_schemas=["app"], types=["table"], allowed_types=["table"])
    assert C.prove_complete(objects, objects, status, request).first().complete
    assert not C.prove_complete(objects, objects, status, request | dict(include=["X*"])).first().complete
    assert not C.prove_complete(objects, objects.limit(3), status, request).first().complete


def test_newest_record_of_a_hot_key(spark):
    now = F.lit(dt.datetime(2024, 6, 1))
    rows = spark.range(5000).selectExpr(
        "id as record_id", "case when id % 3 = 0 then 'hot' else concat('k', id % 100) end as session_key", "'r' as request",
        "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) as created_at", "timestamp'2025-01-01' as expires_at", "'ready' as status", "'all' as selection_mode",
    )
    latest, skipped = C.latest_eligible(rows, ["session_key", "request"], now)
    assert {r.session_key: r.record_id for r in latest.collect()}["hot"] == 4998
    assert {r.reason: r.n for r in skipped.collect()} == {"superseded": 5000 - 101}
    assert "Window" not in latest._jdf.queryExecution().executedPlan().toString()


def test_patterns():
    import fnmatch
    import re

    for p in ["a*", "?b", "[a-c]x*", "[!a]x", "a.b", "a[b", "x|y", "*", "[]]a"]:
        for s in ["a", "ab", "bb", "cx1", "dx", "axb", "a.b", "a[b", "x|y", "", "a\nb", "]a"]:
            want = bool(re.match(fnmatch.translate(p), s))
            assert bool(re.match(C.glob_regex(p).replace("\\z", "\\Z"), s)) == want, (p, s)


# Context index --------------------------------------------------------------------------------------

ENTRY = dict(
    schema_name="app", object_name="A", object_type="table", context="um", description="d", tags=["base", "um"], classification_status="confirmed",
    classification_source="rule", source_fingerprint="sha256:" + "0" * 64, content_hash="sha256:" + "1" * 64, managed_relative_path="um/tables/A.sql",
    header_version=1, output_format_version="2", evidence=["ev_1"], active=True,
)
SCHEMA = (
    "schema_name string, object_name string, object_type string, context string, description string, tags array<string>, classification_status string, "
    "classification_source string, source_fingerprint string, content_hash string, managed_relative_path string, header_version int, "
    "output_format_version string, evidence array<string>, active boolean"
)


def entries(spark, *changes):
    return spark.createDataFrame([tuple((ENTRY | c).values()) for c in changes], SCHEMA)


def test_inventory_sync_inserts(spark):
    new = entries(spark, dict(object_name="SYSTEM_CONFIG"), dict(object_name="SYSTEM_CONFIG_K8S"), dict(object_name="SOME_PROC", object_type="procedure"))
    result = I.sync_result(I.upsert_actions(entries(spark).limit(0) if False else new.limit(0), new)).first()
    assert result.asDict() == dict(inserted=3, updated=0, owner_values_preserved=0, unchanged=0, deactivated=0)


def test_owner_values_survive(spark):
    old = entries(spark, dict(classification_source="owner", context="x", tags=["x"]), dict(object_name="B"), dict(object_name="C", active=False))
    new = entries(spark, dict(content_hash=None), dict(object_name="B"), dict(object_name="C", description=None))
    after = {(r.object_name, r.active): r for r in I.upsert(old, new).collect()}
    a = after["A", True]
    assert (a.context, a.tags, a.classification_source, a.content_hash) == ("x", ["x"], "owner", None)
    assert ("C", False) in after and after["C", True].description is None
    actions = {r.object_name: (r.action, r.owner_values_preserved) for r in I.upsert_actions(old, new).collect()}
    assert actions == {"A": ("update", True), "B": ("unchanged", False), "C": ("insert", False)}
    again = {r.object_name: r.action for r in I.upsert_actions(I.upsert(old, new), new).collect()}
    assert set(again.values()) == {"unchanged"}
    owner = entries(spark, dict(classification_source="owner", context="y"))
    assert [r.context for r in I.upsert(old, owner).where("object_name = 'A'").collect()] == ["y"]


def test_entry_rules(spark):
    broken = {
        "schema_name": dict(schema_name=""), "object_name": dict(object_name="a\nb"), "context": dict(context="Bad"), "description": dict(description="x" * 2001),
        "tags": dict(tags=["um", "base"]), "content_hash": dict(content_hash="sha256:X"), "evidence": dict(evidence=["b", "a"]),
        "coherent_classification": dict(classification_status="unresolved"), "object_type": dict(object_type="view"),
    }
    for rule, change in broken.items():
        assert [r.rule for r in I.validate_entries(entries(spark, change)).collect()] == [rule], rule
    fine = dict(classification_status="unresolved", classification_source="unknown", context=None, tags=[], evidence=[], content_hash=None)
    assert I.validate_entries(entries(spark, {}, fine)).count() == 0
    with pytest.raises(ValueError):
        I.deactivate_missing(entries(spark, {}), entries(spark, {}), [], ["table"])


def test_allowed_functions(spark):
    assert len(ALLOWED) == 71
    with pytest.raises(ValueError):
        call("pg_sleep", F.lit(1))
    register(spark)
    row = spark.sql("""select strpos('abc', 'c') a, json_value('{"x":1}', '$.x') b, iif(1 > 0, 'y', 'n') c, jsonb_extract_path_text('{"k":"v"}', 'k') d""").first()
    assert tuple(row) == (3, "1", "y", "v")
