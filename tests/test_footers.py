"""Footers as a table."""

from pyspark.sql import functions as F

from tableguard.sources import footers as FT


def test_a_thousand_files_in_one_job(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("part"), F.format_string("k%05d", "id").alias("key"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"), F.lit("secret").alias("pwd"))
    rows.repartition(8, "part").write.partitionBy("part").parquet(str(tmp_path / "lake" / "t.parquet"))
    rows.limit(0).drop("part").write.parquet(str(tmp_path / "lake" / "none"))
    folder = str(tmp_path / "lake")
    files = FT.files_of(spark, folder).where("path like '%/t.parquet/%'")
    assert files.count() == 1000
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    read = FT.footers(files, protected=["PWD"]).cache()
    assert read.count() == 3000
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert len(jobs) <= 6  # a count, a listing and one pass over all footers, whatever the number of files
    assert read.where("column_name = 'pwd' and (least is not null or greatest is not null)").count() == 0
    assert read.where("column_name = 'n'").agg(F.sum("nulls")).first()[0] == 1000
    got = {r.table_name: (r.files, r.rows) for r in FT.table_sizes(spark, folder).collect()}
    assert got["t"] == (1000, 5000) and "none" not in got
    near = FT.groups_between(read, "key", "k00100", "k00102")
    assert near.count() >= 3 and near.count() == read.where("column_name = 'key' and least <= 'k00102' and greatest >= 'k00100'").count()
    assert {(r.column_name, r.bounded) for r in FT.column_bounds(spark, folder, ["pwd"]).collect()} >= {("key", True), ("pwd", False)}
    assert FT.footers(files.limit(0)).count() == 0
