"""Hash trees of inventories."""

import uuid

import pytest
from pyspark.sql import functions as F

from tableguard.operators import bundle as B, fingerprints as FP, merkle as M
from tableguard.session import shared_folder


def files(spark, n=500, **texts):
    rows = [(f"dir{i % 3}/f{i}.sql", texts.get(f"f{i}", f"body {i}")) for i in range(n)]
    return B.inventory(spark.createDataFrame(rows, "path string, content string"))


@pytest.fixture()
def folder(spark):
    return f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"


def test_one_changed_file_is_found_by_reading_its_branch(spark, folder):
    M.write_tree(files(spark), f"{folder}/a")
    M.write_tree(files(spark, f77="other"), f"{folder}/b")
    leaves = M.differing_leaves(spark, f"{folder}/a", f"{folder}/b")
    assert len(leaves) == 1
    got = M.changes(spark, f"{folder}/a", f"{folder}/b")
    assert [(r.path, r.kind) for r in got.collect()] == [("dir2/f77.sql", "changed")]
    branch = M.branch(spark, f"{folder}/b", leaves)
    scan = next(x for x in branch._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "leaf#" in scan.split("PartitionFilters: [")[1].split("]")[0] and branch.count() < 5
    read = branch.select(F.input_file_name().alias("f")).distinct().collect()
    assert all(f"leaf={leaves[0]}/" in r.f for r in read)


@pytest.mark.parametrize("depth", [1, 2])
def test_added_removed_and_equal(spark, folder, depth):
    M.write_tree(files(spark, 40), f"{folder}/a", depth=depth)
    M.write_tree(files(spark, 42).where("path <> 'dir0/f3.sql'"), f"{folder}/b", depth=depth)
    M.write_tree(files(spark, 40).repartition(7), f"{folder}/c", depth=depth)
    got = {(r.path, r.kind) for r in M.changes(spark, f"{folder}/a", f"{folder}/b", depth=depth).collect()}
    assert got == {("dir0/f3.sql", "removed"), ("dir1/f40.sql", "added"), ("dir2/f41.sql", "added")}
    assert M.differing_leaves(spark, f"{folder}/a", f"{folder}/c", depth) == [] and M.changes(spark, f"{folder}/a", f"{folder}/c", depth=depth).count() == 0
    assert M.root(spark, f"{folder}/a").first() == M.root(spark, f"{folder}/c").first() and M.root(spark, f"{folder}/a").first().rows == 40


def test_odd_inventories(spark, folder):
    odd = spark.createDataFrame([(None, 1, "x"), ("a", None, None), ("b", 2, "y")], "path string, size_bytes long, sha256 string")
    M.write_tree(odd, f"{folder}/a")
    M.write_tree(odd.where("path is not null").withColumn("sha256", F.when(F.col("path") == "a", "now").otherwise(F.col("sha256"))), f"{folder}/b")
    M.write_tree(odd.limit(0), f"{folder}/none")
    got = {(r.path, r.kind) for r in M.changes(spark, f"{folder}/a", f"{folder}/b").collect()}
    assert got == {(None, "removed"), ("a", "changed")}
    assert {r.kind for r in M.changes(spark, f"{folder}/none", f"{folder}/b").collect()} == {"added"}
    assert M.changes(spark, f"{folder}/none", f"{folder}/none").count() == 0
    with pytest.raises(ValueError):
        M.write_tree(odd.withColumn("leaf", F.lit(1)), f"{folder}/x")
    with pytest.raises(ValueError):
        M.write_tree(odd, f"{folder}/x", depth=5)


def test_sealed_digests_see_every_row(spark):
    rows = files(spark, 50)
    one = B.inventory_hash(rows).first()
    assert one == B.inventory_hash(rows.repartition(6)).first() and (one.files, one.bytes) == (50, rows.agg(F.sum("size_bytes")).first()[0])
    for other in (files(spark, 50, f7="x"), files(spark, 49), rows.unionByName(rows.limit(1))):
        assert B.inventory_hash(other).first().inventory_sha256 != one.inventory_sha256
    none = B.inventory_hash(rows.limit(0)).first()
    assert none.files == 0 and none.bytes == 0 and none.inventory_sha256.startswith("sha256:")
    assert FP.sealed_digest(rows, F.col("sha256"), F.lit(None).cast("string")).first().rows == 50
