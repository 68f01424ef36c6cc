"""Catalog metadata as DataFrames, from databases over JDBC or from lake folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableguard.operators.catalog import object_id, object_type

KINDS = ("objects", "columns", "constraints", "foreign_keys", "indexes", "comments", "dependencies", "definitions")

# One query per metadata kind. {schemas} is the quoted list of schemas. Every engine returns the
# same column names per kind.
_STANDARD = {
    "objects": """
        select table_schema as schema_name, table_name as object_name, 'table' as raw_type
        from information_schema.tables
        where table_type = 'BASE TABLE' and table_schema in ({schemas})
        union all
        select routine_schema, routine_name, lower(routine_type)
        from information_schema.routines
        where routine_type in ('PROCEDURE', 'FUNCTION') and routine_schema in ({schemas})""",
    "columns": """
        select table_schema as schema_name, table_name, column_name, data_type,
               case when is_nullable = 'YES' then 1 else 0 end as nullable,
               ordinal_position as ordinal
        from information_schema.columns where table_schema in ({schemas})""",
    "constraints": """
        select t.table_schema as schema_name, t.table_name, t.constraint_name, t.constraint_type,
               k.column_name, k.ordinal_position as ordinal, c.check_clause as expression
        from information_schema.table_constraints t
        left join information_schema.key_column_usage k
          on k.constraint_schema = t.constraint_schema and k.constraint_name = t.constraint_name
         and k.table_name = t.table_name
        left join information_schema.check_constraints c
          on c.constraint_schema = t.constraint_schema and c.constraint_name = t.constraint_name
        where t.table_schema in ({schemas})""",
    "definitions": """
        select routine_schema as schema_name, routine_name as object_name, lower(routine_type) as raw_type,
               1 as line, routine_definition as text
        from information_schema.routines
        where routine_type in ('PROCEDURE', 'FUNCTION') and routine_schema in ({schemas})""",
    # Source and target columns are paired by position, so composite keys stay one key.
    "foreign_keys": """
        select s.table_schema as schema_name, s.table_name, s.constraint_name,
               s.column_name as source_column, t.table_schema as target_schema,
               t.table_name as target_table, t.column_name as target_column,
               s.ordinal_position as ordinal
        from information_schema.referential_constraints r
        join information_schema.key_column_usage s
          on s.constraint_schema = r.constraint_schema and s.constraint_name = r.constraint_name
        join information_schema.key_column_usage t
          on t.constraint_schema = r.unique_constraint_schema
         and t.constraint_name = r.unique_constraint_name
         and t.ordinal_position = s.position_in_unique_constraint
        where s.table_schema in ({schemas})""",
}

_POSTGRES = _STANDARD | {
    "definitions": """
        select n.nspname as schema_name, p.proname as object_name,
               case p.prokind when 'p' then 'procedure' else 'function' end as raw_type,
               1 as line, pg_get_functiondef(p.oid) as text
        from pg_proc p join pg_namespace n on n.oid = p.pronamespace
        where p.prokind in ('p', 'f') and n.nspname in ({schemas})""",
    "indexes": """
        select n.nspname as schema_name, t.relname as table_name, i.relname as index_name,
               case when x.indisunique then 1 else 0 end as is_unique,
               case when x.indisprimary then 1 else 0 end as is_primary,
               a.attname as column_name, k.pos as column_order,
               case when k.pos > x.indnkeyatts then 1 else 0 end as is_included
        from pg_index x
        join pg_class t on t.oid = x.indrelid
        join pg_class i on i.oid = x.indexrelid
        join pg_namespace n on n.oid = t.relnamespace
        join lateral unnest(x.indkey) with ordinality as k(attnum, pos) on true
        left join pg_attribute a on a.attrelid = t.oid and a.attnum = k.attnum
        where n.nspname in ({schemas})""",
    "comments": """
        select n.nspname as schema_name, c.relname as table_name, d.description
        from pg_description d
        join pg_class c on c.oid = d.objoid and d.objsubid = 0
        join pg_namespace n on n.oid = c.relnamespace
        where n.nspname in ({schemas})""",
    "dependencies": """
        select n.nspname as schema_name, p.proname as routine_name,
               case when p.prokind = 'p' then 'procedure' else 'function' end as routine_type,
               tn.nspname as target_schema, c.relname as target_name
        from pg_depend d
        join pg_proc p on p.oid = d.objid
        join pg_namespace n on n.oid = p.pronamespace
        join pg_class c on c.oid = d.refobjid
        join pg_namespace tn on tn.oid = c.relnamespace
        where n.nspname in ({schemas})""",
}

_MYSQL = _STANDARD | {
    "foreign_keys": """
        select table_schema as schema_name, table_name, constraint_name,
               column_name as source_column, referenced_table_schema as target_schema,
               referenced_table_name as target_table, referenced_column_name as target_column,
               ordinal_position as ordinal
        from information_schema.key_column_usage
        where referenced_table_name is not null and table_schema in ({schemas})""",
    "indexes": """
        select table_schema as schema_name, table_name, index_name,
               1 - non_unique as is_unique,
               case index_name when 'PRIMARY' then 1 else 0 end as is_primary,
               column_name, seq_in_index as column_order, 0 as is_included
        from information_schema.statistics where table_schema in ({schemas})""",
    "comments": """
        select table_schema as schema_name, table_name, table_comment as description
        from information_schema.tables
        where table_comment <> '' and table_schema in ({schemas})""",
    "dependencies": """
        select routine_schema as schema_name, routine_name, 'procedure' as routine_type,
               table_schema as target_schema, table_name as target_name
        from information_schema.routine_table_usage where routine_schema in ({schemas})""",
}

_ORACLE = {
    "definitions": """
        select owner as schema_name, name as object_name, lower(type) as raw_type, line as line, text as text
        from all_source where type in ('PROCEDURE', 'FUNCTION') and owner in ({schemas})""",
    "objects": """
        select owner as schema_name, object_name, lower(object_type) as raw_type
        from all_objects
        where object_type in ('TABLE', 'PROCEDURE', 'FUNCTION') and owner in ({schemas})""",
    "columns": """
        select owner as schema_name, table_name, column_name, data_type,
               decode(nullable, 'Y', 1, 0) as nullable, column_id as ordinal
        from all_tab_columns where owner in ({schemas})""",
    "constraints": """
        select k.owner as schema_name, k.table_name, k.constraint_name, k.constraint_type,
               cc.column_name, cc.position as ordinal, k.search_condition_vc as expression
        from all_constraints k
        left join all_cons_columns cc
          on cc.owner = k.owner and cc.constraint_name = k.constraint_name
        where k.owner in ({schemas})""",
    "foreign_keys": """
        select k.owner as schema_name, k.table_name, k.constraint_name,
               s.column_name as source_column, t.owner as target_schema,
               t.table_name as target_table, t.column_name as target_column,
               s.position as ordinal
        from all_constraints k
        join all_cons_columns s on s.owner = k.owner and s.constraint_name = k.constraint_name
        join all_cons_columns t
          on t.owner = k.r_owner and t.constraint_name = k.r_constraint_name
         and t.position = s.position
        where k.constraint_type = 'R' and k.owner in ({schemas})""",
    "indexes": """
        select i.table_owner as schema_name, i.table_name, i.index_name,
               decode(i.uniqueness, 'UNIQUE', 1, 0) as is_unique,
               decode(k.constraint_type, 'P', 1, 0) as is_primary,
               ic.column_name, ic.column_position as column_order, 0 as is_included
        from all_indexes i
        join all_ind_columns ic on ic.index_owner = i.owner and ic.index_name = i.index_name
        left join all_constraints k on k.owner = i.owner and k.index_name = i.index_name
        where i.table_owner in ({schemas})""",
    "comments": """
        select owner as schema_name, table_name, comments as description
        from all_tab_comments where comments is not null and owner in ({schemas})""",
    "dependencies": """
        select owner as schema_name, name as routine_name, lower(type) as routine_type,
               referenced_owner as target_schema, referenced_name as target_name
        from all_dependencies
        where referenced_type = 'TABLE' and type in ('PROCEDURE', 'FUNCTION')
          and owner in ({schemas})""",
}

_SQLSERVER = _STANDARD | {
    "definitions": """
        select s.name as schema_name, o.name as object_name, o.type as raw_type,
               1 as line, m.definition as text
        from sys.sql_modules m
        join sys.objects o on o.object_id = m.object_id
        join sys.schemas s on s.schema_id = o.schema_id
        where o.type in ('P', 'FN', 'IF', 'TF') and s.name in ({schemas})""",
    "foreign_keys": """
        select schema_name(f.schema_id) as schema_name,
               object_name(f.parent_object_id) as table_name, f.name as constraint_name,
               col_name(c.parent_object_id, c.parent_column_id) as source_column,
               object_schema_name(f.referenced_object_id) as target_schema,
               object_name(f.referenced_object_id) as target_table,
               col_name(c.referenced_object_id, c.referenced_column_id) as target_column,
               c.constraint_column_id as ordinal
        from sys.foreign_keys f
        join sys.foreign_key_columns c on c.constraint_object_id = f.object_id
        where schema_name(f.schema_id) in ({schemas})""",
    "indexes": """
        select object_schema_name(x.object_id) as schema_name,
               object_name(x.object_id) as table_name, x.name as index_name,
               x.is_unique, x.is_primary_key as is_primary,
               col_name(c.object_id, c.column_id) as column_name,
               c.key_ordinal as column_order, c.is_included_column as is_included
        from sys.indexes x
        join sys.index_columns c on c.object_id = x.object_id and c.index_id = x.index_id
        where x.name is not null and object_schema_name(x.object_id) in ({schemas})""",
    "comments": """
        select object_schema_name(p.major_id) as schema_name,
               object_name(p.major_id) as table_name,
               cast(p.value as nvarchar(4000)) as description
        from sys.extended_properties p
        where p.class = 1 and p.minor_id = 0 and p.name = 'MS_Description'
          and object_schema_name(p.major_id) in ({schemas})""",
    "dependencies": """
        select schema_name(o.schema_id) as schema_name, o.name as routine_name,
               case o.type when 'P' then 'procedure' else 'function' end as routine_type,
               object_schema_name(d.referenced_id) as target_schema,
               object_name(d.referenced_id) as target_name
        from sys.sql_expression_dependencies d
        join sys.objects o on o.object_id = d.referencing_id
        where o.type in ('P', 'FN', 'IF', 'TF') and d.referenced_id is not null
          and schema_name(o.schema_id) in ({schemas})""",
    "labels": """
        select schema_name(o.schema_id) as schema_name, o.name as table_name,
               col_name(s.major_id, s.minor_id) as column_name,
               cast(s.information_type as nvarchar(128)) as information_type,
               cast(s.label as nvarchar(128)) as label
        from sys.sensitivity_classifications s
        join sys.objects o on o.object_id = s.major_id
        where schema_name(o.schema_id) in ({schemas})""",
}

# Derby ships with Spark; it is the engine the tests read.
_DERBY = {
    "objects": """
        select s.schemaname as schema_name, t.tablename as object_name, 'table' as raw_type
        from sys.systables t join sys.sysschemas s on s.schemaid = t.schemaid
        where t.tabletype = 'T' and s.schemaname in ({schemas})""",
    "columns": """
        select s.schemaname as schema_name, t.tablename as table_name,
               c.columnname as column_name, cast(c.columndatatype as varchar(128)) as data_type,
               1 as nullable, c.columnnumber as ordinal
        from sys.syscolumns c
        join sys.systables t on t.tableid = c.referenceid
        join sys.sysschemas s on s.schemaid = t.schemaid
        where s.schemaname in ({schemas})""",
    "constraints": """
        select s.schemaname as schema_name, t.tablename as table_name,
               k.constraintname as constraint_name,
               case k.type when 'P' then 'primary key' when 'U' then 'unique'
                           when 'F' then 'foreign key' else 'check' end as constraint_type,
               cast(null as varchar(128)) as column_name, 0 as ordinal,
               cast(null as varchar(128)) as expression
        from sys.sysconstraints k
        join sys.systables t on t.tableid = k.tableid
        join sys.sysschemas s on s.schemaid = k.schemaid
        where s.schemaname in ({schemas})""",
}

QUERIES: dict[str, dict[str, str]] = {
    "postgres": _POSTGRES,
    "mysql": _MYSQL,
    "mariadb": _MYSQL,
    "oracle": _ORACLE,
    "sqlserver": _SQLSERVER,
    "derby": _DERBY,
}
_SCHEMAS = {
    "objects": "schema_name string, object_name string, raw_type string",
    "columns": "schema_name string, table_name string, column_name string, data_type string, nullable boolean, ordinal int",
    "constraints": "schema_name string, table_name string, constraint_name string, constraint_type string, column_name string, ordinal int, expression string",
    "foreign_keys": "schema_name string, table_name string, constraint_name string, source_column string, target_schema string, target_table string, target_column string, ordinal int",
    "indexes": "schema_name string, table_name string, index_name string, is_unique boolean, is_primary boolean, column_name string, column_order int, is_included boolean",
    "comments": "schema_name string, table_name string, description string",
    "dependencies": "schema_name string, routine_name string, routine_type string, target_schema string, target_name string",
    "definitions": "schema_name string, object_name string, raw_type string, line int, text string",
    "labels": "schema_name string, table_name string, column_name string, information_type string, label string",
}


def catalog_query(engine: str, kind: str, schemas: Sequence[str]) -> str | None:
    """Text of one metadata query, or None when the engine has no such table."""
    text = QUERIES[engine].get(kind)
    quoted = ", ".join("'" + s.replace("'", "''") + "'" for s in schemas)
    return None if text is None else text.format(schemas=quoted)


def _table_id(schema: str = "schema_name", table: str = "table_name"):
    return F.concat(F.lit("table:"), F.col(schema), F.lit("."), F.col(table))


def _normal(kind: str, rows: DataFrame) -> DataFrame:
    """Ids and types in the shape the operators take."""
    if kind == "objects":
        rows = rows.withColumn("object_type", object_type("raw_type")).where("object_type is not null")
        return rows.withColumn("object_id", object_id())
    if kind == "definitions":
        # Engines that keep source line by line give many rows; a routine's lines become one text.
        rows = rows.withColumn("object_type", object_type("raw_type")).where("object_type is not null")
        lines = F.array_sort(F.collect_list(F.struct("line", "text")))
        joined = F.array_join(F.transform(lines, lambda x: x["text"]), "")
        return rows.withColumn("object_id", object_id()).groupBy("object_id", "schema_name", "object_name", "object_type").agg(joined.alias("definition"))
    if kind == "foreign_keys":
        return rows.withColumn("source_object_id", _table_id())
    if kind == "dependencies":
        source = F.concat(F.col("routine_type"), F.lit(":"), F.col("schema_name"), F.lit("."), F.col("routine_name"))
        return rows.select(
            source.alias("source_object_id"),
            _table_id("target_schema", "target_name").alias("target_object_id"),
            F.lit("routine_read").alias("edge_type"),
        ).distinct()
    return rows.withColumn("object_id", _table_id())


def read_catalog_jdbc(
    spark: SparkSession, url: str, engine: str, schemas: Sequence[str], options: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """Metadata tables of a database: one query per kind for all schemas, none per object."""
    if not schemas:
        raise ValueError("name at least one schema")
    out = {}
    for kind, schema in _SCHEMAS.items():
        query = catalog_query(engine, kind, schemas)
        if query is None:
            rows = spark.createDataFrame([], schema)
        else:
            raw = spark.read.format("jdbc").option("url", url).option("query", query)
            raw = raw.options(**dict(options or {})).load()
            named = raw.toDF(*[c.lower() for c in raw.columns])
            wanted = spark.createDataFrame([], schema).schema
            rows = named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
        out[kind] = _normal(kind, rows)
    return out


def lake_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table name to path of the parquet files or folders directly inside a folder."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = {s.getPath().getName(): s.getPath().toString() for s in found}
    return {
        n.removesuffix(".parquet"): p for n, p in sorted(names.items()) if not n.startswith(("_", "."))
    }


def read_lake_catalog(spark: SparkSession, folder: str | None = None, database: str | None = None) -> dict[str, DataFrame]:
    """Objects and columns of a folder of parquet tables, or of a database of the Spark catalog.

    Only schemas are read (parquet footers), never rows.
    """
    objects, columns = [], []
    if folder is not None:
        schema = folder.rstrip("/").rsplit("/", 1)[-1]
        for name, path in lake_tables(spark, folder).items():
            objects.append((schema, name, "table"))
            for i, f in enumerate(spark.read.parquet(path).schema.fields, 1):
                columns.append((schema, name, f.name, f.dataType.simpleString(), f.nullable, i))
    else:
        schema = database or spark.catalog.currentDatabase()
        for t in spark.catalog.listTables(schema):
            if t.isTemporary:
                continue
            objects.append((schema, t.name, "table"))
            for i, c in enumerate(spark.catalog.listColumns(f"`{schema}`.`{t.name}`"), 1):
                columns.append((schema, t.name, c.name, c.dataType, c.nullable, i))
    return {
        "objects": _normal("objects", spark.createDataFrame(objects, _SCHEMAS["objects"])),
        "columns": _normal("columns", spark.createDataFrame(columns, _SCHEMAS["columns"])),
    }
