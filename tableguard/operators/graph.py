"""Relationship graph of a catalog: nodes, edges, cardinality and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableguard.operators.spread import spread_left_join

# Edge names in the graph by dependency type.
EDGE_NAMES = {
    "foreign_key": "FOREIGN_KEY",
    "routine_read": "READS_FROM",
    "routine_write": "WRITES_TO",
    "routine_call": "CALLS",
    "boundary": "REFERENCES",
}


def _confirmed(final: DataFrame) -> DataFrame:
    return final.where((F.col("status") == "final_confirmed") & F.col("category").isNotNull()).select(
        "object_id", "category"
    )


def _included(plan: DataFrame) -> DataFrame:
    return plan.where("included").select("object_id").distinct()


def nodes(objects: DataFrame, columns: DataFrame, final: DataFrame, plan: DataFrame, database: str) -> DataFrame:
    """(id, type, name, schema, data_type, materialized) of database, schemas, categories,
    objects and columns."""

    def row(df: DataFrame, id_: Column, kind: Column, name: Column, **more: Column) -> DataFrame:
        return df.select(
            id_.alias("id"),
            kind.alias("type"),
            name.alias("name"),
            more.get("schema", F.lit(None).cast("string")).alias("schema"),
            more.get("data_type", F.lit(None).cast("string")).alias("data_type"),
            more.get("materialized", F.lit(None).cast("boolean")).alias("materialized"),
        )

    schemas = objects.select("schema_name").distinct()
    categories = _confirmed(final).select("category").distinct()
    kept = objects.join(_included(plan).withColumn("m", F.lit(True)), "object_id", "left")
    root = objects.limit(1).select(F.lit(f"database:{database}").alias("i"))
    # Identities are unique inside each kind and the prefixes keep the kinds apart.
    return (
        row(root, F.col("i"), F.lit("database"), F.lit(database))
        .unionByName(
            row(schemas, F.concat(F.lit("schema:"), F.col("schema_name")), F.lit("schema"), F.col("schema_name"))
        )
        .unionByName(
            row(categories, F.concat(F.lit("category:"), F.col("category")), F.lit("category"), F.col("category"))
        )
        .unionByName(
            row(
                kept,
                F.col("object_id"),
                F.col("object_type"),
                F.col("object_name"),
                schema=F.col("schema_name"),
                materialized=F.coalesce(F.col("m"), F.lit(False)),
            )
        )
        .unionByName(
            row(columns, _column_id(), F.lit("column"), F.col("column_name"), data_type=F.col("data_type"))
        )
    )


def _column_id() -> Column:
    return F.concat(F.col("object_id"), F.lit(":column:"), F.col("column_name"))


def boundary(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """Edges with ``boundary_only``: exactly one end is materialised.

    Ends that many edges share are told in several tasks.
    """
    inside = _included(plan)
    s = inside.select(F.col("object_id").alias("source"), F.lit(True).alias("s_in"))
    t = inside.select(F.col("object_id").alias("target"), F.lit(True).alias("t_in"))
    joined = spread_left_join(spread_left_join(edges, s, "source"), t, "target")
    flag = F.coalesce("s_in", F.lit(False)) != F.coalesce("t_in", F.lit(False))
    return joined.select(*edges.columns, flag.alias("boundary_only"))


def edges(
    objects: DataFrame,
    columns: DataFrame,
    constraints: DataFrame,
    final: DataFrame,
    foreign_keys: DataFrame,
    dependencies: DataFrame,
    plan: DataFrame,
    database: str,
) -> DataFrame:
    """Distinct (source, target, type, boundary_only) of the whole graph."""

    def plain(df: DataFrame, s: Column, t: Column, kind: str) -> DataFrame:
        return df.select(
            s.alias("source"), t.alias("target"), F.lit(kind).alias("type"), F.lit(False).alias("boundary_only")
        )

    schema_id = F.concat(F.lit("schema:"), F.col("schema_name"))
    obj = F.col("object_id")
    keyed = (
        constraints.where(F.col("constraint_type") == "primary_key")
        .select("object_id", F.explode("columns").alias("column_name"))
        .join(columns.select("object_id", "column_name"), ["object_id", "column_name"], "left_semi")
    )
    links = fk_edges(foreign_keys).select(
        F.col("source_object_id").alias("source"), F.col("target_object_id").alias("target"), "edge_type"
    ).unionByName(
        dependencies.where(F.col("edge_type") != "foreign_key").select(
            F.col("source_object_id").alias("source"), F.col("target_object_id").alias("target"), "edge_type"
        )
    )
    kinds = F.create_map(*[F.lit(x) for pair in EDGE_NAMES.items() for x in pair])
    flagged = boundary(links.distinct(), plan).select(
        "source", "target", kinds[F.col("edge_type")].alias("type"), "boundary_only"
    )
    known = _confirmed(final).join(objects.select("object_id"), "object_id", "left_semi")
    return (
        plain(objects.select("schema_name").distinct(), F.lit(f"database:{database}"), schema_id, "CONTAINS")
        .unionByName(plain(objects, schema_id, obj, "CONTAINS"))
        .unionByName(plain(known, obj, F.concat(F.lit("category:"), F.col("category")), "BELONGS_TO_CATEGORY"))
        .unionByName(plain(columns, obj, _column_id(), "HAS_COLUMN"))
        .unionByName(plain(keyed, obj, _column_id(), "PRIMARY_KEY"))
        .unionByName(flagged)
        .distinct()
    )


def _column_set(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(x)))), "\0")


def relationships(foreign_keys: DataFrame, constraints: DataFrame, objects: DataFrame, plan: DataFrame) -> DataFrame:
    """Foreign keys with cardinality: M:N of an associative table, 1:1 when the source columns are
    a key, else 1:N; and whether the target is known. Columns are compared without case.

    A table is associative when it has exactly two foreign keys that together are its primary
    key. The two are read as smallest and largest, so no list per table is built.
    """
    keys = constraints.where(F.col("constraint_type").isin("primary_key", "unique")).select(
        F.col("object_id").alias("source_object_id"), _column_set("columns").alias("column_set"), "constraint_type"
    )
    unique = keys.select("source_object_id", "column_set").distinct().withColumn("is_key", F.lit(True))
    primary = keys.where(F.col("constraint_type") == "primary_key").select("source_object_id", "column_set").distinct()
    both = F.struct("name", "source_columns")
    pairs = (
        foreign_keys.groupBy("source_object_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(both).alias("a"), F.max(both).alias("b"))
        .where("n = 2")
        .select(
            "source_object_id",
            _column_set(F.concat(F.col("a.source_columns"), F.col("b.source_columns"))).alias("column_set"),
        )
    )
    associative = (
        pairs.join(primary, ["source_object_id", "column_set"], "left_semi")
        .select("source_object_id")
        .withColumn("associative", F.lit(True))
    )
    known = objects.select(F.col("object_id").alias("target_object_id")).distinct().withColumn("known", F.lit(True))
    rows = (
        foreign_keys.withColumn("column_set", _column_set("source_columns"))
        .join(unique, ["source_object_id", "column_set"], "left")
        .join(associative, "source_object_id", "left")
        .join(known, "target_object_id", "left")
        .withColumn("source", F.col("source_object_id"))
        .withColumn("target", F.col("target_object_id"))
    )
    cardinality = F.when(F.col("associative"), "M:N").when(F.col("is_key"), "1:1").otherwise("1:N")
    resolved = F.col("known").isNotNull()
    flat = rows.select(
        "name",
        "source",
        "target",
        "source_columns",
        "target_columns",
        cardinality.alias("cardinality"),
        F.when(resolved, "confirmed").otherwise("unknown").alias("confidence"),
        resolved.alias("target_resolved"),
    )
    return boundary(flat, plan)


def routine_dependencies(dependencies: DataFrame, objects: DataFrame) -> DataFrame:
    """Dependencies of routines and whether their target is known."""
    known = objects.select(F.col("object_id").alias("target_object_id")).distinct().withColumn("known", F.lit(True))
    rows = dependencies.where(F.col("edge_type") != "foreign_key").join(known, "target_object_id", "left")
    return rows.select(
        "source_object_id", "target_object_id", "edge_type", F.col("known").isNotNull().alias("target_resolved")
    )


def object_index(objects: DataFrame, final: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per object with its confirmed category, whether it is materialised, and its hash."""
    rows = objects.join(_confirmed(final), "object_id", "left").join(
        _included(plan).withColumn("m", F.lit(True)), "object_id", "left"
    )
    return rows.select(
        "object_id",
        F.col("schema_name").alias("schema"),
        F.col("object_name").alias("name"),
        "object_type",
        "category",
        F.coalesce("m", F.lit(False)).alias("materialized"),
        F.col("source_fingerprint").alias("content_hash"),
    )


def tags(index: DataFrame) -> DataFrame:
    """Tags of each indexed object: its category, when confirmed, and its type."""
    return index.select("object_id", F.array_compact(F.array("category", "object_type")).alias("tags"))


def fk_edges(foreign_keys: DataFrame) -> DataFrame:
    """Foreign keys as dependency edges that name the key as evidence."""
    return foreign_keys.select(
        "source_object_id",
        "target_object_id",
        F.lit("foreign_key").alias("edge_type"),
        F.array("name").alias("evidence"),
    )


def key_counts(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows per key value; counted on the map side, so a hot key is one row per task."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """Child key values without a parent row, with the number of child rows."""
    have = parent.select(*[F.col(p).alias(c) for c, p in zip(child_key, parent_key)]).distinct()
    return key_counts(child, child_key).join(have, child_key, "left_anti")


def infer_cardinality(
    child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str]
) -> DataFrame:
    """Cardinality of a relationship as the data shows it, in one row."""
    have = key_counts(parent, parent_key).select(
        *[F.col(p).alias(c) for c, p in zip(child_key, parent_key)], F.col("n").alias("parents")
    )
    joined = key_counts(child, child_key).join(have, child_key, "left")
    stats = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        F.count(F.lit(1)).alias("child_keys"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_children"),
        F.coalesce(F.max("parents"), F.lit(0)).alias("max_parents"),
        F.count_if(F.col("parents").isNull()).alias("orphan_keys"),
    )
    cardinality = (
        F.when(F.col("max_parents") > 1, "M:N").when(F.col("max_children") <= 1, "1:1").otherwise("1:N")
    )
    return stats.withColumn("cardinality", cardinality)
