"""Rules as a table, and profiles that merge."""

import random

import pytest
from pyspark.sql import functions as F

from tableguard.operators import objects as O, profiles as PR, ruletable as RT
from tableguard.sources.rules import make_rules


def many_rules(n, seed=1):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdeé_") for _ in range(rng.randint(1, k)))
    return make_rules([
        dict(name=f"c{i}", exact_names=[word(6)], prefixes=[word(3), word(5)], schemas=[word(2)], comment_keywords=[word(4), word(6)]) for i in range(n)
    ])


@pytest.fixture(scope="module")
def objects(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcdeéABC_ ") for _ in range(rng.randint(0, k)))
    rows = [(f"o{i}", word(2), word(9), word(30) if i % 4 else None) for i in range(300)] + [("null", None, None, None)]
    return spark.createDataFrame(rows, "object_id string, schema_name string, object_name string, native_comment string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("object_id", "category", "confidence", "kind", "summary", "authoritative", "seq").collect())


@pytest.mark.parametrize("most_bytes", [1 << 20, 400])
def test_the_table_matches_as_the_projection_does(spark, objects, most_bytes):
    rules = many_rules(60)
    got = rows_of(RT.table_matches(objects, RT.rule_table(spark, rules), most_bytes=most_bytes))
    assert got == rows_of(O.pass1_matches(objects, rules)) and {r[3] for r in got} == set(RT._RANKED)
    assert rows_of(RT.table_matches(objects, RT.rule_table(spark, rules), with_comment=False)) == [r for r in sorted(tuple(x) for x in O._rows(objects, O.rule_matches(rules, False), 1).select("object_id", "category", "confidence", "kind", "summary", "authoritative", "seq").collect())]


def test_ten_thousand_rules_have_the_plan_of_ten(spark, objects):
    plans = []
    for n in (10, 10_000):
        df = RT.table_matches(objects, RT.rule_table(spark, many_rules(n)))
        plans.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1] and df.count() > 1000


def test_empty_table_and_empty_words(spark, objects):
    rules = make_rules([dict(name="all", comment_keywords=[""]), dict(name="any", prefixes=[""])])
    assert rows_of(RT.table_matches(objects, RT.rule_table(spark, rules))) == rows_of(O.pass1_matches(objects, rules))
    assert RT.table_matches(objects, spark.createDataFrame([], "category string, kind string, pattern string")).count() == 0
    assert RT.table_matches(objects.limit(0), RT.rule_table(spark, rules)).count() == 0


@pytest.fixture(scope="module")
def visits(spark):
    return spark.range(6000).select(
        (F.col("id") % 30).alias("day"), F.concat(F.lit("u"), F.col("id") % 900, F.lit("@x.org")).alias("login_note"), F.when(F.col("id") % 3 > 0, "red").when(F.col("id") % 7 > 0, "blue").alias("colour"), F.lit("hunter2").alias("pwd"), "id",
    )


def test_thirty_stored_days_give_the_profile_of_all(spark, visits, tmp_path):
    PR.profile_parts(visits, ["day"]).write.partitionBy("day").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    merged = PR.merge_profiles(stored)
    rows = {(r.column_name, r["class"]): r for r in PR.estimated(merged).collect()}
    whole = {(r.column_name, r["class"]): r for r in PR.estimated(PR.profile_parts(visits)).collect()}
    assert rows.keys() == whole.keys()
    for k, r in rows.items():
        assert (r.n, r.shortest, r.longest) == (whole[k].n, whole[k].shortest, whole[k].longest)
        assert abs(r.distinct_values - whole[k].distinct_values) <= 0.05 * whole[k].distinct_values
    assert rows["login_note", "email"].n == 6000 and abs(rows["login_note", "email"].distinct_values - 900) < 50
    assert [(x.item, x["count"]) for x in rows["colour", "public"].most_frequent][:2] == [("red", 4000), ("blue", 1714)]
    shown = [x.item for r in rows.values() for x in r.most_frequent or []]
    assert not any("@" in x or x == "hunter2" for x in shown if x)


def test_rollup_of_stored_parts(visits):
    parts = PR.profile_parts(visits, ["day"])
    rolled = PR.rollup_profiles(parts, "day", "column_name", "class")
    by_level = {r.level: (r["count"], r.n) for r in rolled.groupBy("level").agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()}
    total = 6000 * 2 + visits.where("colour is not null").count()
    assert by_level[0] == (1, total) and by_level[1] == (30, total) and by_level[2][1] == by_level[3][1] == total
    assert PR.estimated(PR.profile_parts(visits.limit(0))).count() == 0
