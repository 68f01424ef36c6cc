"""Checks of catalog tables, samples, plans and records."""

from pyspark.sql import functions as F

from checks.base import (
    COLUMNS, CONSTRAINT_ROWS, CONTACTS, FOREIGN_KEYS, OBJECTS, RECORDS, Tables, check, ctes, digest_sql, SEAL, sealed_sql,
)
from checks.texts import _secret_steps
from tableguard.functions import fixed as X
from tableguard.operators import catalog as C, fingerprints as FP

_SCHEMAS = [f"brand_{i}" for i in range(1, 21)]
_IN_SCHEMAS = "schema_name IN (" + ", ".join(f"'{s}'" for s in _SCHEMAS) + ")"
_RAW = f"select p_partkey, schema_name, object_name, raw_type from ({OBJECTS}) x"

_TYPE = """CASE WHEN lower(raw_type) IN ('table', 'base table', 'u') THEN 'table' WHEN lower(raw_type) IN ('procedure', 'stored procedure', 'p') THEN 'procedure'
 WHEN lower(raw_type) IN ('function', 'fn', 'if', 'tf') THEN 'function' END"""


@check("object_types", f"{ctes(o=OBJECTS)} SELECT raw_type, {_TYPE} AS object_type, count(*) AS n FROM o GROUP BY ALL")
def object_types(t: Tables):
    rows = t.sql(OBJECTS).select("raw_type", C.object_type("raw_type").alias("object_type"))
    return rows.groupBy("raw_type", "object_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "discovered_objects",
    f"""{ctes(o=_RAW)}, t AS (SELECT *, {_TYPE} AS object_type FROM o WHERE {_IN_SCHEMAS})
SELECT object_type || ':' || schema_name || '.' || object_name AS object_id, object_type FROM t
WHERE object_type IN ('table', 'procedure') AND NOT (lower(object_name) GLOB '*_widget_*' OR lower(object_name) GLOB 'um_?ed_*' OR lower(object_name) GLOB '*[37]')""",
)
def discovered_objects(t: Tables):
    found = C.discover(t.sql(_RAW), _SCHEMAS, ["table", "procedure"], ["*_WIDGET_*", "um_?ed_*", "*[37]"])
    return found.select("object_id", "object_type")


@check("schema_scope", f"{ctes(o=OBJECTS)} SELECT DISTINCT schema_name, {_IN_SCHEMAS} AS allowed FROM o")
def schema_scope(t: Tables):
    return C.visible_schemas(t.sql(OBJECTS), _SCHEMAS)


_INCLUDE = ["lut_*", "*Bolt_1?", "nothing_*", "*WIDGET_7"]
_EXCLUDE = ["*WIDGET*", "lut_*"]


def _request(t: Tables):
    return C.request_filter(t.sql(OBJECTS), _SCHEMAS, ["table", "function"], _INCLUDE, _EXCLUDE)


_SCOPED = f"{ctes(o=OBJECTS)}, s AS (SELECT * FROM o WHERE {_IN_SCHEMAS} AND object_type IN ('table', 'function')), c AS (SELECT * FROM s WHERE NOT (object_name GLOB '*WIDGET*' OR object_name GLOB 'lut_*'))"


@check(
    "requested_objects",
    f"{_SCOPED} SELECT object_id FROM c WHERE {' OR '.join(f'lower(object_name) GLOB {p.lower()!r}' for p in _INCLUDE)}",
)
def requested_objects(t: Tables):
    return _request(t)[0].select("object_id")


@check(
    "unmatched_patterns",
    f"""{_SCOPED}, p AS (SELECT unnest({_INCLUDE}) AS pattern),
m AS (SELECT pattern, (SELECT count(*) FROM s WHERE lower(object_name) GLOB lower(pattern)) AS seen, (SELECT count(*) FROM c WHERE lower(object_name) GLOB lower(pattern)) AS kept FROM p)
SELECT pattern, seen > 0 AS excluded_by_policy FROM m WHERE kept = 0""",
)
def unmatched_patterns(t: Tables):
    return _request(t)[1]


_FP = "'sha256:' || sha256(schema_name || chr(0) || object_type || chr(0) || object_name || chr(0) || modified_at)"


@check("object_fingerprints", f"{ctes(o=OBJECTS)} SELECT object_id, {_FP} AS fingerprint FROM o")
def object_fingerprints(t: Tables):
    return FP.with_fingerprints(t.sql(OBJECTS)).select("object_id", "fingerprint")


_PAYLOAD = "schema_name || chr(0) || object_type || chr(0) || object_name || chr(0) || fingerprint"


@check(
    "schema_fingerprints",
    f"{ctes(o=OBJECTS)}, f AS (SELECT *, {_FP} AS fingerprint FROM o), {sealed_sql('f', _PAYLOAD, "schema_name || chr(0) || object_type || chr(0) || object_name", 'schema_name')} SELECT schema_name, CAST(sum(n) AS BIGINT) AS object_count, {SEAL} AS schema_fingerprint FROM g GROUP BY schema_name",
)
def schema_fingerprints(t: Tables):
    return FP.schema_fingerprint(FP.with_fingerprints(t.sql(OBJECTS)), ["schema_name"])


_DEFINITIONS = f"""select 'procedure:app.' || c_name as object_id, 'set token = ' || chr(34) || contact || chr(34) || '; select ' || chr(39) || 'to 0812345678' || chr(39) as definition from ({CONTACTS}) x"""


@check(
    "definition_fingerprints",
    f"""{ctes(d=_DEFINITIONS)}, {_secret_steps('d', 'definition', 'object_id')}, m AS (SELECT object_id, replace(clean, 'to 0812345678', 'to [REDACTED:PHONE]') AS definition FROM s3)
SELECT object_id, definition, 'sha256:' || sha256(definition) AS source_fingerprint FROM m""",
)
def definition_fingerprints(t: Tables):
    return FP.definition_fingerprint(t.sql(_DEFINITIONS))


# Two versions of one inventory.
_BEFORE = f"select object_id, object_type, object_name, modified_at as fingerprint, 'body of ' || object_name as definition, 'rows' as sample, 'deps' as dependencies from ({OBJECTS}) x where object_name not like '%RING%'"
_AFTER = f"select object_id, object_type, object_name, case when p_partkey % 4 = 0 then modified_at || 'x' else modified_at end as fingerprint from ({OBJECTS}) x where object_name not like '%NUT%'"
_DIFF = f"""{ctes(b=_BEFORE, a=_AFTER)}, d AS (SELECT coalesce(a.object_id, b.object_id) AS object_id, b.fingerprint AS old, a.fingerprint AS new,
 CASE WHEN b.object_id IS NULL THEN 'added' WHEN a.object_id IS NULL THEN 'deleted' WHEN a.fingerprint IS NOT DISTINCT FROM b.fingerprint THEN 'unchanged' ELSE 'changed' END AS change
 FROM b FULL JOIN a ON a.object_id = b.object_id)"""


@check("catalog_diff", f"{_DIFF} SELECT object_id, change, old, new FROM d")
def catalog_diff(t: Tables):
    return C.diff(t.sql(_BEFORE), t.sql(_AFTER))


@check(
    "catalog_diff_summary",
    f"{_DIFF} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS reused, true AS complete FROM d",
)
def catalog_diff_summary(t: Tables):
    return C.diff_summary(C.diff(t.sql(_BEFORE), t.sql(_AFTER)))


@check(
    "carried_forward",
    f"""{ctes(b=_BEFORE, a=_AFTER)}, j AS (SELECT a.object_id, a.object_type, b.definition, b.sample, b.dependencies, coalesce(a.fingerprint = b.fingerprint, false) AS reused FROM a LEFT JOIN b ON a.object_id = b.object_id)
SELECT object_id, CASE WHEN reused THEN definition END AS definition, CASE WHEN reused AND object_type <> 'table' THEN sample END AS sample, CASE WHEN reused AND object_type <> 'table' THEN dependencies END AS dependencies, reused FROM j""",
)
def carried_forward(t: Tables):
    return C.carry_forward(t.sql(_BEFORE), t.sql(_AFTER)).select("object_id", "definition", "sample", "dependencies", "reused")


_CONTEXTS = """select o_custkey as context, case when o_custkey % 7 = 0 then 'failed' else 'synced' end as status, count(*) as added, sum(case when o_orderstatus = 'F' then 1 else 0 end) as changed,
 sum(case when o_orderstatus = 'O' then 1 else 0 end) as deleted, max(o_orderkey) as reused, min(o_orderkey) as refreshed, true as complete from {orders} group by o_custkey"""
_SKIPS = "select o_orderpriority as reason, sum(case when o_orderstatus = 'P' then 1 else 0 end) as n from {orders} group by o_orderpriority"
_SUMS = ", ".join(f"CAST(sum({c}) FILTER (status = 'synced') AS BIGINT) AS {c}" for c in ("added", "changed", "deleted", "reused", "refreshed"))


@check(
    "sync_totals",
    f"""{ctes(c=_CONTEXTS, s=_SKIPS)} SELECT CAST((SELECT sum(n) FROM s) + count(*) AS BIGINT) AS considered, count(*) FILTER (status = 'synced') AS synced, CAST((SELECT sum(n) FROM s) AS BIGINT) AS skipped,
 count(*) FILTER (status = 'failed') AS failed, {_SUMS}, bool_and(complete) FILTER (status = 'synced') AND count(*) FILTER (status = 'failed') = 0 AS complete FROM c""",
)
def sync_totals(t: Tables):
    return C.sync_totals(t.sql(_CONTEXTS), t.sql(_SKIPS))


@check(
    "grouped_constraints",
    f"""{ctes(c=CONSTRAINT_ROWS)} SELECT object_id, constraint_name, CASE lower(constraint_type) WHEN 'unique' THEN 'unique' ELSE 'primary_key' END AS constraint_type,
 string_agg(column_name, ',' ORDER BY ordinal) AS columns, max(expression) AS expression FROM c GROUP BY ALL""",
)
def grouped_constraints(t: Tables):
    rows = C.group_constraints(t.sql(CONSTRAINT_ROWS))
    return rows.withColumn("columns", F.array_join("columns", ","))


_INDEX_ROWS = f"""select object_id, 'IX_' || cast(ordinal % 2 as string) as index_name, ordinal % 2 = 0 as is_unique, ordinal = 1 as is_primary, column_name, ordinal as column_order, ordinal > 4 as is_included from ({COLUMNS}) x"""


@check(
    "grouped_indexes",
    f"""{ctes(i=_INDEX_ROWS)} SELECT object_id, index_name, bool_or(is_unique) AS is_unique, bool_or(is_primary) AS is_primary,
 coalesce(string_agg(column_name, ',' ORDER BY column_order) FILTER (NOT is_included), '') AS key_columns, coalesce(string_agg(column_name, ',' ORDER BY column_order) FILTER (is_included), '') AS included_columns FROM i GROUP BY ALL""",
)
def grouped_indexes(t: Tables):
    rows = C.group_indexes(t.sql(_INDEX_ROWS))
    return rows.withColumn("key_columns", F.array_join("key_columns", ",")).withColumn("included_columns", F.array_join("included_columns", ","))


# Composite keys: all foreign-key columns of an object that reference one target.
_FK_ROWS = f"""select source_object_id, 'FK_' || target_object_id as constraint_name, source_column, 'app' as target_schema, replace(target_object_id, ':', '_') as target_table, target_column, ordinal from ({FOREIGN_KEYS}) x"""


@check(
    "grouped_foreign_keys",
    f"""{ctes(f=_FK_ROWS)} SELECT source_object_id, constraint_name AS name, 'table:app.' || target_table AS target_object_id,
 string_agg(source_column, ',' ORDER BY ordinal) AS source_columns, string_agg(target_column, ',' ORDER BY ordinal) AS target_columns FROM f GROUP BY ALL""",
)
def grouped_foreign_keys(t: Tables):
    rows = C.group_foreign_keys(t.sql(_FK_ROWS))
    return rows.withColumn("source_columns", F.array_join("source_columns", ",")).withColumn("target_columns", F.array_join("target_columns", ","))


_ORDER_SAMPLE = "o_orderkey, o_custkey, o_orderstatus"


@check("table_sample", f"SELECT {_ORDER_SAMPLE} FROM orders ORDER BY o_orderkey LIMIT 20")
def table_sample(t: Tables):
    return C.sample(t.orders, 20, primary=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@check(
    "sample_per_nation",
    "SELECT c_nationkey, c_custkey, c_name, sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS sample_rank FROM customer) WHERE sample_rank <= 12",
)
def sample_per_nation(t: Tables):
    return C.sample_groups(t.customer, ["c_nationkey"], ["c_custkey"], 12).select("c_nationkey", "c_custkey", "c_name", "sample_rank")


@check(
    "sample_shortage",
    "SELECT o_custkey, 20 AS requested_count, least(20, count(*)) AS actual_count, CASE WHEN count(*) < 20 THEN 'source_returned_fewer_rows' END AS shortage_reason, true AS deterministic FROM orders GROUP BY o_custkey",
)
def sample_shortage(t: Tables):
    """Twenty orders of every customer, and who has fewer."""
    return C.sample_status(C.sample_groups(t.orders, ["o_custkey"], ["o_orderkey"], 20), 20, True, ["o_custkey"])


_LOOKUP_ROWS = """select concat('table:app.', replace(lower(c_mktsegment), ' ', '_')) as object_id, c_custkey, c_name, c_acctbal, c_nationkey from {customer}"""
_LOOKUP_SUPPLIERS = "select 'table:app.supplier' as object_id, s_suppkey, s_name, s_acctbal, s_nationkey from {supplier}"


def _lookup_json(p: str, source: str) -> str:
    alias = f"""'user_' || substr({digest_sql("email", f"{p}_name")}, 1, 10) || '@example.invalid'"""
    k = {"c": "c_custkey", "s": "s_suppkey"}[p]
    return f"""SELECT object_id, '{{"{k}":' || {k} || ',"{p}_name":"' || {alias} || '","{p}_acctbal":"[REDACTED]","{p}_nationkey":' || {p}_nationkey || '}}' AS row FROM {source}"""


@check("lookup_rows", f"""{ctes(a=_LOOKUP_ROWS, b=_LOOKUP_SUPPLIERS)} {_lookup_json("c", "a WHERE object_id NOT LIKE '%furniture'")} UNION ALL {_lookup_json("s", "b")}""")
def lookup_rows(t: Tables):
    """Lookup tables of two layouts: one for each market segment but furniture, and the suppliers."""
    tables = [t.sql(_LOOKUP_ROWS), t.sql(_LOOKUP_SUPPLIERS)]
    columns = None
    for table in tables:
        names = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type")) for i, f in enumerate(table.schema.fields[1:])])
        listed = table.select("object_id").distinct().select("object_id", F.inline(names))
        columns = listed if columns is None else columns.unionByName(listed)
    category = F.when(F.col("object_id").endswith("furniture"), "um").otherwise("lut")
    plan = columns.select("object_id", F.lit("table").alias("object_type"), category.alias("final_category")).distinct()

    def read(ids):
        return next(x for x in tables if (x.columns[1] == "s_suppkey") == (list(ids) == ["table:app.supplier"])).where(F.col("object_id").isin(*ids))

    policy = {"c_name": X.EMAIL, "s_name": X.EMAIL, "c_acctbal": "secret", "s_acctbal": "secret"}
    return C.lookup_rows(plan, columns, read, policy, t.key)


_PRELIM = "CASE WHEN len(list_filter(string_split(lower(object_name), '_'), lambda x: x <> '')) >= 2 AND regexp_matches(list_filter(string_split(lower(object_name), '_'), lambda x: x <> '')[1], '^[a-z][a-z0-9]*$') THEN list_filter(string_split(lower(object_name), '_'), lambda x: x <> '')[1] END"
_ODD_NAMES = f"""select case p_partkey % 6 when 0 then object_name when 1 then '_' || object_name when 2 then cast(p_partkey as string) || '_X' when 3 then replace(object_name, '_', '') when 4 then '__' else 'a__b' end as object_name from ({OBJECTS}) x"""


@check("preliminary_categories", f"{ctes(o=_ODD_NAMES)} SELECT object_name, {_PRELIM} AS category, count(*) AS n FROM o GROUP BY ALL")
def preliminary_categories(t: Tables):
    rows = t.sql(_ODD_NAMES).select("object_name", C.preliminary_category("object_name").alias("category"))
    return rows.groupBy("object_name", "category").agg(F.count(F.lit(1)).alias("n"))


@check(
    "category_preview",
    f"""{ctes(o=OBJECTS)}, p AS (SELECT {_PRELIM} AS category, object_name FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY object_name) AS rn FROM p)
SELECT category, count(*) AS object_count, CASE WHEN category IS NOT NULL THEN string_agg(object_name, ',' ORDER BY object_name) FILTER (rn <= 10) END AS representative_names FROM r GROUP BY category""",
)
def category_preview(t: Tables):
    rows = C.category_preview(t.sql(OBJECTS))
    return rows.withColumn("representative_names", F.array_join("representative_names", ","))


FINAL = f"""select case when object_name like '%GEAR%' then 'gone.' || object_id else object_id end as object_id, case when p_partkey % 11 = 3 then null when object_name like 'LUT%' then 'lut' when object_name like 'UM%' then 'um' when object_name like 'CONTENT%' then 'content' end as category,
 case when p_partkey % 11 = 3 then 'final_unresolved' when p_partkey % 5 = 0 then 'final_suggested' else 'final_confirmed' end as status from ({OBJECTS}) x"""
_JOINED = f"{ctes(o=OBJECTS, f=FINAL)}, j AS (SELECT o.object_id, o.object_type, o.object_name, o.modified_at, f.object_id IS NOT NULL AS known, f.category AS fc, f.status, {_PRELIM.replace('object_name', 'o.object_name')} AS prelim FROM o LEFT JOIN f ON f.object_id = o.object_id)"
_LOOSE = "CASE WHEN known THEN fc ELSE prelim END"
_SURE = "CASE WHEN status = 'final_confirmed' THEN fc END"


def _plan_sql(category: str, included: str, all_mode: bool = False) -> str:
    reason = "'all_mode'" if all_mode else "CASE WHEN included AND final_category = 'lut' THEN 'policy_always_include' WHEN included THEN 'selected_category' ELSE 'intentionally_excluded' END"
    return f"{_JOINED}, c AS (SELECT object_id, object_type, {category} AS final_category FROM j), i AS (SELECT *, coalesce({included}, false) AS included FROM c) SELECT *, {reason} AS reason FROM i"


@check("plan_all", _plan_sql(_LOOSE, "true", True))
def plan_all(t: Tables):
    return C.plan(t.sql(OBJECTS), t.sql(FINAL), "all")


@check("plan_ask", _plan_sql(_LOOSE, "false"))
def plan_ask(t: Tables):
    return C.plan(t.sql(OBJECTS), t.sql(FINAL), "ask")


@check("plan_selected", _plan_sql(_LOOSE, "final_category IN ('lut', 'um', 'small')"))
def plan_selected(t: Tables):
    return C.plan(t.sql(OBJECTS), t.sql(FINAL), "selected", ["um", "small"])


@check("plan_confirmed", _plan_sql(_SURE, "final_category IN ('lut', 'content')"))
def plan_confirmed(t: Tables):
    return C.plan(t.sql(OBJECTS), t.sql(FINAL), "selected", ["content"], confirmed_only=True)


@check(
    "sitemap",
    f"{_JOINED} SELECT object_id, {_LOOSE} AS category, object_type, CASE WHEN {_LOOSE} = 'lut' THEN 'policy_always_include' WHEN {_LOOSE} = 'um' THEN 'selected_category' ELSE 'intentionally_excluded' END AS inclusion_reason, modified_at AS content_hash FROM j",
)
def sitemap(t: Tables):
    objects = t.sql(OBJECTS).withColumn("source_fingerprint", F.col("modified_at"))
    return C.sitemap(objects, t.sql(FINAL), C.plan(objects, t.sql(FINAL), "selected", ["um"]))


@check("object_page", f"{ctes(o=OBJECTS)} SELECT object_id, object_type FROM o WHERE object_id > 'function:brand_2' ORDER BY object_id LIMIT 101")
def object_page(t: Tables):
    return C.page(t.sql(OBJECTS), "object_id", after="function:brand_2").select("object_id", "object_type")


_NOW = "TIMESTAMP '1999-06-01 00:00:00'"
_REASON = f"""CASE WHEN corrupt THEN 'runtime_state_corrupt' WHEN session_key IS NULL OR session_key = '' THEN 'session_cache_key_missing' WHEN expires_at <= {_NOW} THEN 'expired'
 WHEN status NOT IN ('ready', 'completed', 'completed_with_warnings') THEN 'status_' || status WHEN selection_mode IS NULL OR selection_mode = 'ask' THEN 'selection_incomplete' END"""
_TAGGED = f"{ctes(r=RECORDS)}, t AS (SELECT *, {_REASON} AS reason FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY session_key, request ORDER BY created_at DESC, record_id DESC) AS rn FROM t WHERE reason IS NULL)"


def _latest(t: Tables):
    return C.latest_eligible(t.sql(RECORDS), ["session_key", "request"], F.expr(_NOW))


@check("latest_order_per_customer", f"{_TAGGED} SELECT record_id, session_key, request, status FROM n WHERE rn = 1")
def latest_order_per_customer(t: Tables):
    return _latest(t)[0].select("record_id", "session_key", "request", "status")


@check("skip_reasons", f"{_TAGGED} SELECT coalesce(reason, 'superseded') AS reason, count(*) AS n FROM (SELECT reason FROM t WHERE reason IS NOT NULL UNION ALL SELECT NULL FROM n WHERE rn > 1) GROUP BY ALL")
def skip_reasons(t: Tables):
    return _latest(t)[1]


_PINS = "select l_orderkey as record_id, l_returnflag = 'A' and l_linenumber = 1 as active, l_shipdate as expires_at from {lineitem}"


@check(
    "retention",
    f"""{ctes(r=RECORDS, p=_PINS)} SELECT record_id, status FROM r WHERE expires_at <= {_NOW} AND status NOT IN ('running', 'queued')
 AND NOT EXISTS (SELECT 1 FROM p WHERE p.record_id = r.record_id AND (p.active OR p.expires_at > {_NOW}))""",
)
def retention(t: Tables):
    return C.retention(t.sql(RECORDS), t.sql(_PINS), F.expr(_NOW)).select("record_id", "status")


# All objects, marked with the stage that failed for them, if any.
_MARKED = f"""select x.*, case when object_name like '%GEAR%' then case p_partkey % 3 when 0 then 'analysis' when 1 then 'sample' else 'dependencies' end end as stage, 'E' as error_code from ({OBJECTS}) x"""
_FAILURES = f"select object_id, stage, error_code from ({_MARKED}) m where stage is not null"
_GOOD = f"select * from ({_MARKED}) m where coalesce(stage, '') <> 'analysis'"
_STATUS = f"""{ctes(g=_GOOD, f=_FAILURES)}, s AS (SELECT (SELECT count(*) FROM g) AS analysed, (SELECT count(*) FROM f WHERE stage = 'analysis') AS failed, (SELECT count(*) FROM f WHERE stage = 'sample') AS fs,
 (SELECT count(*) FROM f WHERE stage = 'dependencies') AS fd, (SELECT count(*) FROM g WHERE split_part(lower(object_name), '_', 1) IN ('lut', 'um')) AS materialised)"""


def _status(t: Tables):
    good = t.sql(_GOOD)
    none = t.spark.createDataFrame([], "object_id string, category string, status string")
    return C.status(good, t.sql(_FAILURES), C.plan(good, none, "selected", ["um"]))


@check(
    "catalog_status",
    f"""{_STATUS} SELECT analysed + failed AS discovered, analysed, failed, materialised, analysed - materialised AS excluded,
 concat_ws(',', CASE WHEN fs > 0 THEN 'sample_extraction_incomplete' END, CASE WHEN fd > 0 THEN 'dependency_extraction_incomplete' END) AS warnings FROM s""",
)
def catalog_status(t: Tables):
    return _status(t)


@check(
    "completeness_proof",
    f"""{ctes(o=OBJECTS, g=_GOOD, f=_FAILURES)} SELECT (SELECT count(DISTINCT lower(object_id)) FROM o) AS expected, (SELECT count(DISTINCT lower(object_id)) FROM o WHERE lower(object_id) NOT IN (SELECT lower(object_id) FROM g)) AS missing,
 0 AS unexpected, (SELECT count(*) FROM f WHERE stage = 'analysis') AS failed, false AS complete""",
)
def completeness_proof(t: Tables):
    request = {"mode": "all", "schemas": ["a"], "allowed_schemas": ["a"], "types": ["table"], "allowed_types": ["table"]}
    return C.prove_complete(t.sql(OBJECTS), t.sql(_GOOD), _status(t), request)


_EXPECTED = f"select case ordinal when 6 then 'object' when 7 then 'index' else 'column' end as kind, object_id || '.' || column_name as name, '([' || data_type || '])' as definition from ({COLUMNS}) x where ordinal <> 2"
_ACTUAL = f"select case ordinal when 6 then 'object' when 7 then 'index' else 'column' end as kind, object_id || '.' || column_name as name, case when length(object_id) % 5 = 0 then upper(data_type) || ' not null' else upper(data_type) end as definition from ({COLUMNS}) x where ordinal <> 3 and not (ordinal = 7 and length(object_id) % 2 = 0)"


@check(
    "schema_drift",
    f"""{ctes(e=_EXPECTED, a=_ACTUAL)}, es AS (SELECT kind, name, upper(regexp_replace(definition, '[\\[\\]()\\s]', '', 'g')) AS expected FROM e), acts AS (SELECT kind, name, upper(regexp_replace(definition, '[\\[\\]()\\s]', '', 'g')) AS actual FROM a),
j AS (SELECT coalesce(es.kind, acts.kind) AS kind, coalesce(es.name, acts.name) AS name, expected, actual FROM es FULL JOIN acts ON es.kind = acts.kind AND es.name = acts.name)
SELECT kind, name, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN CASE WHEN kind = 'object' THEN 'unexpected' ELSE 'extra' END ELSE 'mismatch' END AS state, expected, actual FROM j WHERE expected IS DISTINCT FROM actual""",
)
def schema_drift(t: Tables):
    return C.schema_drift(t.sql(_EXPECTED), t.sql(_ACTUAL))
