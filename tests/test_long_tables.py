"""Tables as long as the catalog stay off the driver, however small their files are."""

import re

import pytest

from checks import base, objectgraph  # noqa: F401  (importing registers the checks)
from tableguard.operators import objects as O
from tableguard.operators.spread import spread_left_join


def broadcast_scans(df) -> list[str]:
    """Scans of files below the broadcasts of a plan."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = re.search(r"\w", line + "x").start()
        inside = None if inside is not None and depth <= inside else inside
        if inside is not None and "FileScan" in line:
            found.append(line.strip())
        if inside is None and "BroadcastExchange" in line:
            inside = depth
    return found


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    spark.range(300).selectExpr(
        "id as p_partkey", "'red bolt' as p_name", "'Brand#3' as p_brand", "'SMALL' as p_type", "cast(id % 40 as int) as p_size"
    ).write.parquet(f"{at}/part.parquet")
    spark.range(900).selectExpr(
        "id % 300 as l_partkey", "id % 7 as l_suppkey", "cast(1 + id % 7 as int) as l_linenumber", "'N' as l_returnflag"
    ).write.parquet(f"{at}/lineitem.parquet")
    return at


QUERIES = ["neighbourhood_vote", "evidence", "final_pass", "classification_changes", "open_requests", "sources_and_tags"]


@pytest.mark.parametrize("name", QUERIES)
def test_objects_are_never_broadcast(spark, folder, name):
    assert broadcast_scans(base.QUERIES[name](spark, folder)) == []


def test_long_facts_are_hashed_by_tasks(spark, folder):
    facts = spark.read.parquet(f"{folder}/part.parquet").selectExpr("p_partkey as k", "p_size")
    rows = spark.range(40).selectExpr("if(id < 20, null, id % 5 + 298) as k", "id")
    short, long = spread_left_join(rows, facts, "k"), spread_left_join(rows, facts, "k", long=True)
    assert broadcast_scans(short) and not broadcast_scans(long)
    assert sorted(map(str, short.collect())) == sorted(map(str, long.collect())) and long.count() == 40


def test_votes_of_parallel_edges_and_unknown_neighbours(spark):
    edges = spark.createDataFrame(
        [("a", "b", "foreign_key"), ("a", "b", "foreign_key"), ("b", "a", "foreign_key"), ("a", "gone", "routine_read"), ("c", "b", "foreign_key"),
         ("c", "d", "foreign_key"), ("e", "e", None), (None, "b", "foreign_key"), ("f", None, "routine_call")],
        "source_object_id string, target_object_id string, edge_type string",
    )
    first = spark.createDataFrame([("b", "um"), ("d", "lut"), ("e", "um"), ("a", None)], "object_id string, category string")
    votes = {r.object_id: (r.category, r.kind) for r in O.neighbour_vote(edges, first).collect()}
    near = "foreign_key_neighborhood"
    assert votes == {"a": ("um", "routine_dependency"), "e": ("um", near), None: ("um", "routine_dependency")}


def test_votes_of_hubs_as_counted_one_by_one(spark):
    pairs = [(f"s{i}", "hub") for i in range(40)] + [("hub", f"t{i}") for i in range(40)] + [(f"s{i}", f"t{i % 7}") for i in range(40)]
    kinds = ["foreign_key", "routine_call", None]
    rows = [(a, b, kinds[(i + k) % 3]) for i, (a, b) in enumerate(pairs) for k in range(1 + i % 3)] + [("s1", None, "foreign_key"), (None, None, None)]
    category = {f"s{i}": ["um", "lut", None][i % 3] for i in range(30)} | {f"t{i}": "um" for i in range(0, 40, 2)} | {"hub": "um"}
    want = {}
    for x in {x for r in rows for x in r[:2]}:
        near = [(b if x == a else a, k) for a, b, k in rows if x in (a, b)] + [(a, k) for a, b, k in rows if a == b == x]
        found = {category.get(n) for n, _ in near} - {None}
        if len(found) == 1:
            want[x] = (*found, "routine_dependency" if any(k in O.ROUTINE_EDGES for _, k in near) else "foreign_key_neighborhood")
    edges = spark.createDataFrame(rows, "source_object_id string, target_object_id string, edge_type string")
    first = spark.createDataFrame(list(category.items()), "object_id string, category string")
    assert {r.object_id: (r.category, r.kind) for r in O.neighbour_vote(edges, first).collect()} == want and len(want) > 20


def exchanges(df) -> int:
    """Shuffles of a plan that has run, without those used again."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"[ -] Exchange ", text.split("== Initial Plan ==")[0]))


def test_requests_share_the_shuffles_of_pass_and_evidence(spark, folder):
    # Beyond the evidence: the pass, its overrides, its open objects, citations and texts, and what is gathered.
    shared = exchanges(base.QUERIES["evidence"](spark, folder))
    assert shared < exchanges(base.QUERIES["open_requests"](spark, folder)) <= shared + 6


def test_requests_of_unknown_and_repeated_objects(spark):
    one, two, none = ("um", 0.7, "columns", "ev_1"), ("lut", 0.6, "comment", "ev_2"), ("um", 0.5, "columns", None)
    final = spark.createDataFrame(
        [("a", "final_unresolved", [one, two]), ("a", "final_suggested", [two]), ("b", "final_confirmed", [one]), ("c", "final_unresolved", []),
         ("d", "final_unresolved", None), ("e", "final_unresolved", [none, one]), (None, "final_unresolved", [one])],
        "object_id string, status string, candidates array<struct<category string, confidence double, kind string, evidence_id string>>",
    )
    known = spark.createDataFrame(
        [("ev_1", "a", "one"), ("ev_1", "a", "another"), ("ev_2", "a", None), ("ev_9", "a", "not cited"), ("ev_1", "b", "confirmed"), ("ev_1", None, "nobody's"), (None, "e", "no id"),
         ("ev_1", "gone", "gone")],
        "evidence_id string, object_id string, summary string",
    )
    got = sorted([(r.object_id or "", r.sanitized_evidence, r.candidate_categories) for r in O.open_requests(final, known).collect()], key=str)
    said = [None, "another", "one", None]
    assert got == sorted([("a", said, ["um", "lut"]), ("a", said, ["lut"]), ("c", [], []), ("d", [], None), ("e", [], ["um", "um"]), ("", [], ["um"])], key=str)
