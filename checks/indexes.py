"""Checks of the context index, managed files and materialised output."""

import uuid

from pyspark.sql import functions as F

from checks.base import ENTRIES, FILES, INDEX, OBJECTS, Tables, check, ctes, SEAL, sealed_sql, sha_text, with_lists
from checks.catalogs import FINAL
from checks.objectgraph import RULES
from checks.texts import _ASSIGN, _BEARER, _DONE, _GATED, _n, _secret_steps
from tableguard.operators import bundle as B, corpus as CO, fingerprints as FP, index as I, merkle as MK, texts as TX
from tableguard.session import shared_folder

_OWNED = ["context", "description", "tags_csv", "classification_status", "classification_source"]
_TECH = ["source_fingerprint", "content_hash", "managed_relative_path", "header_version", "output_format_version", "evidence_csv"]
_KEYS = ["schema_name", "object_name", "object_type"]
_ON = " AND ".join(f"a.{k} = e.{k}" for k in _KEYS)
_HELD = "a.classification_source IS NOT DISTINCT FROM 'owner' AND e.classification_source <> 'owner' AND e.object_name IS NOT NULL AND a.object_name IS NOT NULL"
_FIELDS = [f"CASE WHEN e.object_name IS NULL OR ({_HELD}) THEN a.{c} ELSE e.{c} END AS {c}" for c in _OWNED]
_FIELDS += [f"CASE WHEN e.object_name IS NULL THEN a.{c} ELSE e.{c} END AS {c}" for c in _TECH]
_SAME = " AND ".join(f"{f.rsplit(' AS ', 1)[0]} IS NOT DISTINCT FROM a.{c}" for f, c in zip(_FIELDS, _OWNED + _TECH))
_MERGED = f"""{ctes(i=INDEX, e=ENTRIES)}, a AS (SELECT * FROM i WHERE active),
m AS (SELECT {', '.join(f'coalesce(a.{k}, e.{k}) AS {k}' for k in _KEYS)}, {', '.join(_FIELDS)}, coalesce({_HELD}, false) AS preserved,
 CASE WHEN e.object_name IS NULL THEN NULL WHEN a.object_name IS NULL THEN 'insert' WHEN {_SAME} THEN 'unchanged' ELSE 'update' END AS action FROM a FULL JOIN e ON {_ON})"""


def _index(t: Tables):
    return with_lists(t.sql(sha_text(INDEX)))


def _entries(t: Tables):
    return with_lists(t.sql(sha_text(ENTRIES)))


def _flat(df):
    out = df
    for c in ("tags", "evidence"):
        if c in df.columns:
            out = out.withColumn(f"{c}_csv", F.array_join(c, ",")).drop(c)
    return out


@check(
    "context_upsert",
    f"{_MERGED} SELECT {', '.join(_KEYS + _OWNED + _TECH)}, true AS active FROM m UNION ALL SELECT {', '.join(_KEYS + _OWNED + _TECH)}, false FROM i WHERE NOT active",
)
def context_upsert(t: Tables):
    return _flat(I.upsert(_index(t), _entries(t)))


@check("upsert_actions", f"{_MERGED} SELECT {', '.join(_KEYS)}, action, preserved AS owner_values_preserved FROM m WHERE action IS NOT NULL")
def upsert_actions(t: Tables):
    return I.upsert_actions(_index(t), _entries(t))


_SCOPE = "schema_name IN ('seg_building', 'seg_machinery') AND object_type IN ('table', 'function')"
_LIVE = "a AS (SELECT * FROM i WHERE active)"
_GONE = f"NOT EXISTS (SELECT 1 FROM e WHERE e.schema_name = i.schema_name AND e.object_name = i.object_name AND e.object_type = i.object_type)"


@check(
    "sync_result",
    f"""{_MERGED} SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (preserved AND action IS NOT NULL) AS owner_values_preserved,
 count(*) FILTER (action = 'unchanged') AS unchanged, (SELECT count(*) FROM i WHERE active AND {_SCOPE} AND {_GONE}) AS deactivated FROM m""",
)
def sync_result(t: Tables):
    gone = I.missing_rows(_index(t), _entries(t), ["seg_building", "seg_machinery"], ["table", "function"])
    return I.sync_result(I.upsert_actions(_index(t), _entries(t)), gone)


@check("deactivate_missing", f"{ctes(i=INDEX, e=ENTRIES)} SELECT id, active AND NOT ({_SCOPE} AND {_GONE}) AS active FROM i")
def deactivate_missing(t: Tables):
    rows = I.deactivate_missing(_index(t), _entries(t), ["seg_building", "seg_machinery"], ["table", "function"])
    return rows.select("id", "active")


@check(
    "index_search",
    f"{ctes(i=INDEX)} SELECT id, object_name, context FROM i WHERE active AND schema_name IN ('seg_building', 'seg_machinery') AND classification_status = 'confirmed' AND list_contains(string_split(tags_csv, ','), 'base') AND id > 40 ORDER BY id LIMIT 51",
)
def index_search(t: Tables):
    rows = I.search(_index(t), ["seg_building", "seg_machinery"], status="confirmed", tag="base", after=40, limit=50)
    return rows.select("id", "object_name", "context")


# Entries with one broken rule each, by supplier and customer number.
_BAD = f"""select case when c_custkey % 8 = 1 then '' else schema_name end as schema_name, case when c_custkey % 8 = 2 then object_name || chr(10) else object_name end as object_name, object_type,
 case when c_custkey % 8 = 3 then 'Bad Context' else context end as context, description, case when c_custkey % 8 = 4 then 'um,base' when c_custkey % 8 = 5 then 'a,a' else tags_csv end as tags_csv, classification_status,
 case when c_custkey % 8 = 6 then 'unknown' else classification_source end as classification_source, case when c_custkey % 8 = 7 then 'sha256:zz' else source_fingerprint end as source_fingerprint, content_hash, managed_relative_path,
 header_version, output_format_version, evidence_csv, active from (select i.*, i.id as c_custkey from ({INDEX}) i) x"""
_RULE_SQL = {
    "schema_name": "schema_name = '' OR regexp_matches(schema_name, '[\\x00\\r\\n]')",
    "object_name": "regexp_matches(object_name, '[\\x00\\r\\n]')",
    "context": "context IS NOT NULL AND NOT regexp_full_match(context, '[a-z][a-z0-9_-]{0,63}')",
    "tags": "array_to_string(list_sort(list_distinct(list_filter(string_split(tags_csv, ','), lambda x: x <> ''))), ',') <> tags_csv",
    "source_fingerprint": "source_fingerprint IS NOT NULL AND NOT regexp_full_match(source_fingerprint, 'sha256:[0-9a-f]{64}')",
    "coherent_classification": "CASE WHEN classification_status = 'unresolved' THEN context IS NOT NULL OR tags_csv <> '' OR classification_source <> 'unknown' ELSE context IS NULL OR classification_source = 'unknown' END",
}


@check(
    "entry_violations",
    f"{ctes(b=_BAD)} {' UNION ALL '.join(f'SELECT {chr(44).join(_KEYS)}, {chr(39)}{r}{chr(39)} AS rule FROM b WHERE {c}' for r, c in _RULE_SQL.items())}",
)
def entry_violations(t: Tables):
    return I.validate_entries(with_lists(t.sql(sha_text(_BAD))))


_TWICE = f"select upper(schema_name) as schema_name, object_name, object_type, classification_source, active from ({INDEX}) x where context = 'um' union all select schema_name, object_name, object_type, classification_source, active from ({INDEX}) y"


@check(
    "batch_violations",
    f"""{ctes(b=_TWICE)}, d AS (SELECT *, object_type || ':' || lower(schema_name) || '.' || lower(object_name) AS identity FROM b)
SELECT 'duplicate_identity' AS rule, identity FROM d GROUP BY identity HAVING count(*) > 1 UNION ALL SELECT 'owner_requires_owner_mode', identity FROM d WHERE classification_source = 'owner' UNION ALL SELECT 'deactivation_requires_owner_mode', identity FROM d WHERE NOT active""",
)
def batch_violations(t: Tables):
    return I.validate_batch(t.sql(sha_text(_TWICE)))


@check(
    "entry_scope",
    f"{ctes(e=ENTRIES)} SELECT object_name, CASE WHEN schema_name NOT IN ('seg_building', 'supply') THEN 'SCHEMA_NOT_ALLOWED' WHEN object_type <> 'table' THEN 'OBJECT_TYPE_NOT_ALLOWED' ELSE 'kept' END AS outcome FROM e",
)
def entry_scope(t: Tables):
    kept, rejected = I.scope_filter(_entries(t), ["seg_building", "supply"], ["table"])
    return kept.select("object_name", F.lit("kept").alias("outcome")).unionByName(rejected.select("object_name", F.col("reason").alias("outcome")))


# Managed files ------------------------------------------------------------------------------------

_HEADER_FIELDS = f"""select object_id, 'parquet' as engine, schema_name, object_name, object_type, cast(null as string) as context, case when p_partkey % 2 = 0 then 'say ' || chr(34) || 'hi' || chr(34) end as description,
 'unresolved' as classification_status, 'unknown' as classification_source, cast(null as string) as source_fingerprint, 1 as header_version, '2' as output_format_version,
 case object_type when 'table' then 'create table [' || schema_name || '].[' || object_name || '] (a int) -- create table x' when 'procedure' then 'CREATE OR ALTER PROC ' || schema_name || ' . ' || object_name || ' as select ' || chr(39) || 'create table y' || chr(39)
 else '/* create /* nested */ table z */ alter function ' || object_name || ' ()' end || chr(10) as body, p_partkey from ({OBJECTS}) x"""


def _headers(t: Tables):
    none = F.array().cast("array<string>")
    rows = t.sql(_HEADER_FIELDS).withColumn("tags", none).withColumn("evidence", none)
    return rows.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("body", 256)))


_JSON = """'{"classification_source":"unknown","classification_status":"unresolved","content_hash":"sha256:' || sha256(body) || '","context":null,"description":' || CASE WHEN description IS NULL THEN 'null' ELSE '"say \\"hi\\""' END
 || ',"engine":"parquet","evidence":[],"header_version":1,"object_id":"' || object_id || '","object_name":"' || object_name || '","object_type":"' || object_type || '","output_format_version":"2","schema_name":"' || schema_name || '","source_fingerprint":null,"tags":[]}'"""
_CONTENT = f"'-- context: ' || {_JSON} || chr(10) || body"


@check("rendered_headers", f"{ctes(h=_HEADER_FIELDS)} SELECT object_id, {_CONTENT} AS content FROM h")
def rendered_headers(t: Tables):
    return CO.render_header(_headers(t)).select("object_id", "content")


def _corpus(t: Tables):
    """Rendered files; some without a header, some broken in one way."""
    full = CO.render_header(_headers(t))
    k = F.col("p_partkey") % 6
    content = (
        F.when(k == 1, F.col("body"))
        .when(k == 2, F.replace("content", F.lit('"unknown"'), F.lit('"owner"')))
        .when(k == 3, F.concat("content", F.lit("-- edited")))
        .when(k == 4, F.concat("content", F.lit("create table other (b int)")))
        .otherwise(F.col("content"))
    )
    return full.select(F.concat("schema_name", F.lit("/"), "object_name", F.lit(".sql")).alias("path"), content.alias("content"), "p_partkey", "object_id")


_STATE = "CASE p_partkey % 6 WHEN 1 THEN 'missing' WHEN 2 THEN 'invalid' ELSE 'ok' END"


@check("parsed_headers", f"{ctes(h=_HEADER_FIELDS)} SELECT schema_name || '/' || object_name || '.sql' AS path, {_STATE} AS state, CASE WHEN p_partkey % 6 NOT IN (1, 2) THEN object_id END AS object_id, CASE WHEN p_partkey % 6 = 2 THEN 'classification' ELSE '' END AS problems, body || CASE p_partkey % 6 WHEN 3 THEN '-- edited' WHEN 4 THEN 'create table other (b int)' ELSE '' END AS body FROM h")
def parsed_headers(t: Tables):
    rows = CO.parse_header(_corpus(t).select("path", "content"))
    return rows.select("path", "state", F.col("header.object_id").alias("object_id"), F.array_join("problems", ",").alias("problems"), "body")


@check(
    "detected_identities",
    f"""{ctes(h=_HEADER_FIELDS)} SELECT object_id, CASE WHEN p_partkey % 6 = 4 THEN 2 ELSE 1 END AS declarations, CASE WHEN p_partkey % 6 <> 4 THEN object_type END AS declared_type,
 CASE WHEN p_partkey % 6 <> 4 THEN CASE object_type WHEN 'function' THEN 'dbo' ELSE schema_name END END AS declared_schema, CASE WHEN p_partkey % 6 <> 4 THEN object_name END AS declared_name FROM h""",
)
def detected_identities(t: Tables):
    rows = _headers(t).withColumn("body", F.when(F.col("p_partkey") % 6 == 4, F.concat("body", F.lit("create table other (b int)"))).otherwise(F.col("body")))
    return CO.detect_identity(rows.select("object_id", "body"), "body").drop("body")


_PROBLEM = """CASE WHEN p_partkey % 6 = 2 THEN 'MANAGED_SQL_HEADER_INVALID' WHEN p_partkey % 6 = 4 THEN 'FOLDER_SQL_OBJECT_COUNT_INVALID' WHEN p_partkey % 6 <> 1 AND object_type = 'function' THEN 'MANAGED_SQL_IDENTITY_MISMATCH'
 WHEN p_partkey % 6 = 3 THEN 'MANAGED_SQL_CONTENT_DRIFT' END"""


@check("identity_problems", f"{ctes(h=_HEADER_FIELDS)} SELECT schema_name || '/' || object_name || '.sql' AS path, {_PROBLEM} AS problem FROM h")
def identity_problems(t: Tables):
    return CO.check_identity(_corpus(t).select("path", "content"), "parquet").select("path", "problem")


def _folder(t: Tables):
    """One folder per type so that equal names in several schemas collide."""
    bodies = _headers(t).withColumn("object_name", F.regexp_replace("object_name", "_[0-9]+$", ""))
    sql = F.concat(F.lit("create table ["), "schema_name", F.lit("].["), "object_name", F.lit("] (a int)"))
    return bodies.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "object_name", F.lit(".sql")).alias("path"), sql.alias("content"))


_FOLDER = f"""{ctes(h=_HEADER_FIELDS)}, b AS (SELECT p_partkey, schema_name, regexp_replace(object_name, '_[0-9]+$', '') AS name FROM h),
c AS (SELECT *, CAST(p_partkey AS VARCHAR) || '/' || name || '.sql' AS path, 'table:' || schema_name || '.' || name AS object_id,
 (CASE WHEN starts_with(name, 'LUT_') THEN ['lut'] ELSE [] END) || (CASE WHEN name IN ('SMALL_RING_3', 'UM_BLUE_BOLT_2') OR starts_with(name, 'UM_') OR schema_name = 'brand_3' THEN ['um'] ELSE [] END)
 || (CASE WHEN starts_with(name, 'CONTENT_') OR schema_name = 'brand_7' THEN ['content'] ELSE [] END) AS cats FROM b),
d AS (SELECT *, CASE WHEN len(cats) = 1 THEN cats[1] END AS context, CASE WHEN len(cats) = 1 THEN cats[1] ELSE 'unknowns' END || '/tables/' || name || '.sql' AS destination FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY lower(object_id)) AS ids, count(*) OVER (PARTITION BY lower(destination)) AS dests FROM d)"""


@check(
    "folder_plan",
    f"{_FOLDER} SELECT path, destination, object_id, context, CASE WHEN ids > 1 THEN 'FOLDER_DUPLICATE_OBJECT_IDENTITY' WHEN dests > 1 THEN 'FOLDER_DESTINATION_COLLISION' END AS problem FROM n",
)
def folder_plan(t: Tables):
    return CO.folder_plan(_folder(t), RULES, "parquet").select("path", "destination", "object_id", "context", "problem")


def _moved(t: Tables):
    """All files, some of them at another place than expected."""
    path = F.when(F.col("path").contains("ANVIL"), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return _corpus(t).select(path.alias("path"), "content")


def _managed(t: Tables):
    """An index and the files it points to; some files drifted."""
    idx = _headers(t).withColumn("managed_relative_path", F.concat("schema_name", F.lit("/"), "object_name", F.lit(".sql")))
    return idx.withColumn("active", F.lit(True))


@check(
    "generation_drift",
    f"""{ctes(h=_HEADER_FIELDS)} SELECT object_id, CASE p_partkey % 6 WHEN 1 THEN 'header_invalid' WHEN 2 THEN 'header_invalid' WHEN 3 THEN 'body_differs' WHEN 4 THEN 'body_differs' ELSE NULL END AS drift FROM h WHERE NOT contains(object_name, 'ANVIL') UNION ALL SELECT object_id, 'file_missing' FROM h WHERE contains(object_name, 'ANVIL')""",
)
def generation_drift(t: Tables):
    corpus = CO.parse_header(_moved(t))
    return I.generation_plan(_managed(t), corpus, include_unresolved=True).select("object_id", "drift")


_DRIFT_OUT = f"{ctes(h=_HEADER_FIELDS)} SELECT schema_name || '/' || object_name || '.sql' AS destination, CASE WHEN contains(object_name, 'ANVIL') THEN 'file_missing' WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN 'file_changed' ELSE 'not_in_manifest' END AS reason FROM h WHERE contains(object_name, 'ANVIL') OR p_partkey % 6 BETWEEN 1 AND 4 OR object_type = 'table'"


@check("corpus_drift", _DRIFT_OUT)
def corpus_drift(t: Tables):
    full = CO.render_header(_headers(t))
    path = F.concat("schema_name", F.lit("/"), "object_name", F.lit(".sql"))
    digest = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    header = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CO.HEADER.fields])
    plan = full.select(path.alias("destination"), "object_id", digest.alias("output_hash"), header.alias("header"))
    listed = F.when(F.col("object_type") == "table", F.concat(F.lit("old/"), path)).otherwise(path)
    manifest = full.select(listed.alias("path"), digest.alias("sha256"))
    return CO.corpus_drift(plan, _moved(t), manifest).select("destination", "reason")


# Output bundles -----------------------------------------------------------------------------------

_PATHED = f"""select o.object_id, o.schema_name, case when p_partkey % 10 = 0 then '..' else regexp_replace(o.object_name, '_[0-9]+', '') || ' (x)' end as object_name, o.object_type,
 case f.status when 'final_confirmed' then f.category end as category from ({OBJECTS}) o left join ({FINAL}) f on f.object_id = o.object_id"""
_SEG = "nullif(trim(regexp_replace({c}, '[^A-Za-z0-9_.-]+', '_', 'g'), '.'), '')"
_PATHS = f"""{ctes(p=_PATHED)}, b AS (SELECT *, coalesce(category, 'unknowns') || '/' || CASE object_type WHEN 'table' THEN 'tables' WHEN 'function' THEN 'functions' ELSE 'store_procedures' END || '/' AS base, {_SEG.format(c='object_name')} AS seg FROM p),
q AS (SELECT *, base || seg || '.sql' AS short FROM b), w AS (SELECT *, min(object_id) OVER (PARTITION BY short) AS owner FROM q),
r AS (SELECT object_id, CASE WHEN seg IS NULL THEN NULL WHEN object_id = owner THEN short ELSE base || {_SEG.format(c='schema_name')} || '__' || seg || '__' || substr(sha256(object_id), 1, 10) || '.sql' END AS path FROM w)"""


@check("output_paths", f"{_PATHS} SELECT object_id, path FROM r")
def output_paths(t: Tables):
    return B.output_paths(t.sql(_PATHED)).select("object_id", "path")


@check("output_path_problems", f"{_PATHS} SELECT object_id, 'UNSAFE_OUTPUT_PATH' AS problem FROM r WHERE path IS NULL")
def output_path_problems(t: Tables):
    return B.path_problems(B.output_paths(t.sql(_PATHED)))


_INV = f"{ctes(f=FILES)}, inv AS (SELECT batch, path, octet_length(encode(content)) AS size_bytes, 'sha256:' || sha256(content) AS sha256, output_profile FROM f)"
_INV_PAYLOAD = "path || chr(0) || CAST(size_bytes AS VARCHAR) || chr(0) || sha256"


def _inventory(t: Tables):
    return t.sql(FILES).select("batch", "output_profile", "path", F.octet_length("content").cast("long").alias("size_bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


@check("manifest", f"{_INV} SELECT path, size_bytes, sha256 FROM inv")
def manifest(t: Tables):
    return B.inventory(t.sql(FILES))


@check(
    "inventory_hashes",
    f"{_INV}, {sealed_sql('inv', _INV_PAYLOAD, 'path', 'batch', 'size_bytes')} SELECT batch, CAST(sum(n) AS BIGINT) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, {SEAL} AS inventory_sha256 FROM g GROUP BY batch",
)
def inventory_hashes(t: Tables):
    return B.inventory_hash(_inventory(t), ["batch"])


@check(
    "sealed_inventories",
    f"""{_INV}, r AS (SELECT batch, substr(sha256(path), 1, 3) AS b, sha256({_INV_PAYLOAD}) AS h FROM inv), g AS (SELECT batch, b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM r GROUP BY batch, b)
SELECT batch, CAST(sum(n) AS BIGINT) AS rows, 'sha256:' || sha256(string_agg(b || h, '' ORDER BY b)) AS digest FROM g GROUP BY batch""",
)
def sealed_inventories(t: Tables):
    return FP.sealed_digest(_inventory(t), FP.joined("path", "size_bytes", "sha256"), F.col("path"), ["batch"])


_ASM = f"{_INV}, a AS (SELECT path, count(DISTINCT sha256) AS k, min(size_bytes) AS size_bytes, min(sha256) AS sha256 FROM inv GROUP BY path)"


@check("assembled_files", f"{_ASM} SELECT path, size_bytes, sha256 FROM a WHERE k = 1")
def assembled_files(t: Tables):
    return B.assemble(_inventory(t))[0]


@check("assembly_conflicts", f"{_ASM} SELECT 'EXPORT_BATCH_CONFLICT' AS problem, path FROM a WHERE k > 1 UNION ALL SELECT 'EXPORT_PROFILE_CONFLICT', NULL WHERE (SELECT count(DISTINCT output_profile) FROM inv) > 1")
def assembly_conflicts(t: Tables):
    return B.assemble(_inventory(t))[1]


_RESULTS = """select 'part:' || cast(l_partkey as string) as object_id, case when l_partkey % 5 = 0 and l_tax > 0.07 then 'parse_failed' when l_partkey % 7 = 0 then 'rolled_back' else 'formatted' end as status, 'd' || cast(l_partkey % 3 as string) as detail from {lineitem}"""
_MERGE = f"{ctes(r=_RESULTS)}, g AS (SELECT object_id, count(DISTINCT status || detail) AS k, min(status) AS status, min(detail) AS detail FROM r GROUP BY object_id)"


@check("merged_results", f"{_MERGE} SELECT object_id, CASE WHEN k = 1 THEN status ELSE 'conflict' END AS status FROM g")
def merged_results(t: Tables):
    merged, conflicts = B.merge_results(t.sql(_RESULTS))
    return merged.select("object_id", "status").unionByName(conflicts.select("object_id", F.lit("conflict").alias("status")))


@check("result_counts", f"{_MERGE} SELECT count(*) AS requested, count(*) FILTER (status = 'formatted') AS formatted, count(*) FILTER (status = 'parse_failed') AS parse_failed_preserved, count(*) FILTER (status = 'rolled_back') AS format_failed_preserved, true AS accounted FROM g WHERE k = 1")
def result_counts(t: Tables):
    return B.result_counts(B.merge_results(t.sql(_RESULTS))[0])


_PREV = "SELECT DISTINCT path FROM f WHERE batch < 'src5'"
_IN = "SELECT DISTINCT path FROM f WHERE batch >= 'src3'"


def _two(t: Tables):
    inv = _inventory(t)
    return inv.where("batch < 'src5'"), inv.where("batch >= 'src3'")


@check("stale_paths", f"{ctes(f=FILES)} SELECT path FROM ({_PREV}) WHERE path NOT IN ({_IN})")
def stale_paths(t: Tables):
    return B.stale(*_two(t))


@check(
    "unmanaged_conflicts",
    f"""{_INV}, p AS (SELECT DISTINCT path FROM inv WHERE batch < 'src2'), ex AS (SELECT DISTINCT path, sha256 FROM inv WHERE batch < 'src5'), nw AS (SELECT DISTINCT path, sha256 FROM inv WHERE batch >= 'src3')
SELECT DISTINCT ex.path FROM ex JOIN nw ON ex.path = nw.path AND ex.sha256 <> nw.sha256 WHERE ex.path NOT IN (SELECT path FROM p)""",
)
def unmanaged_conflicts(t: Tables):
    inv = _inventory(t)
    existing, incoming = _two(t)
    return B.unmanaged_conflicts(existing.select("path", "sha256").distinct(), inv.where("batch < 'src2'"), incoming.select("path", "sha256").distinct()).distinct()


_DECL = "select case when source = 'src3' then 'old/' else '' end || cast(doc_id as string) as path, n_chars as size_bytes, case when doc_id % 13 = 0 then 'x' else lang end as sha256 from {documents}"
_REAL = "select case when source = 'src11' then 'new/' else '' end || cast(doc_id as string) as path, case when doc_id % 11 = 0 then n_chars + 1 else n_chars end as size_bytes, lang as sha256 from {documents}"


@check(
    "reread_states",
    f"{ctes(d=_DECL, a=_REAL)} SELECT coalesce(d.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN d.path IS NULL THEN 'undeclared' ELSE 'mismatch' END AS state FROM d FULL JOIN a ON a.path = d.path WHERE a.path IS NULL OR d.path IS NULL OR a.size_bytes <> d.size_bytes OR a.sha256 <> d.sha256",
)
def reread_states(t: Tables):
    return B.reread_check(t.sql(_DECL), t.sql(_REAL))


_FILES_OF_DOCS = "select concat(source, '/', lang, '/', cast(doc_id as string), '.txt') as path, text, doc_id from {documents}"


def _text_files(rows):
    return rows.select("path", F.octet_length("text").cast("long").alias("size_bytes"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("sha256"))


#: What is wrong in each case: counts that are off, and what was done to the files.
_CASES = {
    "passing": {}, "discovered": {"discovered": 1}, "analysed": {"analysed": 1, "excluded": 1}, "materialised": {"materialised": -1, "excluded": 1},
    "excluded": {"excluded": 2}, "version": {}, "profile": {}, "missing_file": {}, "undeclared_file": {}, "changed_file": {}, "conflict": {}, "no_manifest": {},
}
_COUNTED = "SELECT count(*) AS discovered, count(*) FILTER (c_acctbal >= 0) AS analysed, count(*) FILTER (c_acctbal >= 0 AND c_nationkey <> 5) AS materialised, count(*) FILTER (c_acctbal >= 0 AND c_nationkey = 5) AS excluded FROM customer"
_INCOMPLETE = ("missing_file", "undeclared_file", "changed_file", "no_manifest", "conflict")


def _case_sql(name: str) -> str:
    off = {k: _CASES[name].get(k, 0) for k in ("discovered", "analysed", "materialised", "excluded")}
    tests = {
        "conflicting_managed_path": "false" if name == "conflict" else "true", "output_profile_mismatch": "false" if name == "profile" else "true",
        "assembled_inventory_mismatch": "false" if name in _INCOMPLETE else "true", "output_format_version_mismatch": "false" if name == "version" else "true",
        "discovered_count_mismatch": f"discovered + {off['discovered']} = discovered", "analyzed_count_mismatch": f"analysed + {off['analysed']} = analysed",
        "materialized_count_mismatch": f"materialised + {off['materialised']} = materialised",
        "exclusion_count_mismatch": f"analysed + {off['analysed']} = materialised + {off['materialised']} + excluded + {off['excluded']}",
    }
    errors = ", ".join(f"CASE WHEN NOT ({ok}) THEN '{code}' END" for code, ok in tests.items())
    return (
        f"SELECT '{name}' AS name, concat_ws(',', {errors}) = '' AS valid, {tests['discovered_count_mismatch']} AS discovered_count_valid, {tests['analyzed_count_mismatch']} AS analyzed_count_valid, "
        f"{tests['materialized_count_mismatch']} AS materialized_count_valid, {tests['exclusion_count_mismatch']} AS exclusion_count_valid, {tests['output_format_version_mismatch']} AS output_format_version_valid, "
        f"{tests['assembled_inventory_mismatch']} AS assembled_inventory_complete, concat_ws(',', {errors}) AS errors FROM n"
    )


@check("reconciliation", f"WITH n AS ({_COUNTED}) " + " UNION ALL ".join(map(_case_sql, _CASES)))
def reconciliation(t: Tables):
    """All documents as files and all customers as objects: one sound export, and each fault alone."""
    files = _text_files(t.sql(_FILES_OF_DOCS)).withColumns({"output_format_version": F.lit("2"), "output_profile": F.lit("full")})
    reports = [*(p for p in B.REPORTS["full"] if p != "manifest.yaml"), "manifest.yaml"]
    extra = t.spark.createDataFrame([(p, 1, "r") for p in reports], "path string, size_bytes long, sha256 string")
    content = ["path", "size_bytes", "sha256"]
    one = files.agg(F.min("path")).first()[0]
    this = F.col("path") == one
    counts = t.customer.agg(
        F.count("*").alias("discovered"), F.count_if(F.expr("c_acctbal >= 0")).alias("analysed"),
        F.count_if(F.expr("c_acctbal >= 0 and c_nationkey <> 5")).alias("materialised"), F.count_if(F.expr("c_acctbal >= 0 and c_nationkey = 5")).alias("excluded"),
    )
    expected = {"version": "2", **counts.first().asDict()}
    out = None
    for name, off in _CASES.items():
        declared, given = files, files.select(*content).unionByName(extra)
        if name == "version":
            declared = declared.withColumn("output_format_version", F.when(this, "1").otherwise(F.col("output_format_version")))
        elif name == "profile":
            declared = declared.withColumn("output_profile", F.when(this, "other").otherwise(F.col("output_profile")))
        elif name == "missing_file":
            given = given.where(~this)
        elif name == "undeclared_file":
            declared = declared.where(~this)
        elif name == "changed_file":
            given = given.withColumn("sha256", F.when(this, "x").otherwise(F.col("sha256")))
        elif name == "conflict":
            declared = declared.unionByName(declared.where(this).withColumn("sha256", F.lit("")))
            given = given.where(~this)
        elif name == "no_manifest":
            given = given.where("path <> 'manifest.yaml'")
        status = counts.select(*[(F.col(c) + off.get(c, 0)).alias(c) for c in counts.columns])
        row = B.reconcile(declared, given, status, expected).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@check(
    "masking_report",
    f"""{ctes(gated=_GATED)}, {_secret_steps('gated', 'text', 'doc_id')}, again AS (SELECT secrets, {_n('clean', _ASSIGN)} - {_n('clean', _DONE)} + {_n('clean', _BEARER)} AS residual FROM s3)
SELECT CAST(sum(secrets) AS BIGINT) AS secret_literals_redacted, count(*) FILTER (residual > 0) AS objects_skipped_security FROM again""",
)
def masking_report(t: Tables):
    gated = t.sql(_GATED)
    rows, skipped = TX.redact_corpus(gated, "text"), TX.gated(gated, "text").where("error_code is not null")
    report = B.masking_report(rows, skipped)
    return report.select(F.col("secret_literals_redacted").cast("long"), "objects_skipped_security")


_MOVES = f"select object_id, length(object_id) % 2 = 0 as moved_into_selected, length(object_id) % 3 = 0 as moved_out_of_selected from ({OBJECTS}) x"


@check(
    "classification_report",
    f"{ctes(f=FINAL, m=_MOVES)} SELECT status, category, count(*) AS objects, count(*) FILTER (moved_into_selected) AS moved_into_selected, count(*) FILTER (moved_out_of_selected) AS moved_out_of_selected FROM f LEFT JOIN m USING (object_id) GROUP BY ALL",
)
def classification_report(t: Tables):
    return B.classification_report(t.sql(FINAL), t.sql(_MOVES))


@check(
    "export_report",
    f"""{_INV}, s AS (SELECT c_nationkey, least(12, count(*)) AS n FROM customer GROUP BY c_nationkey) SELECT count(*) AS generated_file_count, CAST(sum(size_bytes) AS BIGINT) AS generated_payload_bytes, (SELECT count(*) FROM part) AS materialized_object_count,
 (SELECT count(*) FROM s) AS sampled_table_count, (SELECT 12 * count(*) FROM s) AS sample_rows_requested, (SELECT CAST(sum(n) AS BIGINT) FROM s) AS sample_rows_actual FROM inv""",
)
def export_report(t: Tables):
    samples = t.customer.groupBy("c_nationkey").agg(F.least(F.lit(12), F.count(F.lit(1))).alias("actual_count"), F.lit(12).alias("requested_count"))
    return B.export_report(_inventory(t), t.part, samples)


@check(
    "inventory_changes",
    f"""{ctes(f=_FILES_OF_DOCS)} SELECT path, CASE WHEN doc_id % 97 = 5 THEN 'removed' WHEN doc_id % 89 = 7 THEN 'added' ELSE 'changed' END AS kind,
 CASE WHEN doc_id % 97 = 5 OR doc_id % 89 <> 7 THEN 'sha256:' || sha256(text) END AS before, CASE WHEN doc_id % 97 <> 5 THEN 'sha256:' || sha256(text || CASE WHEN doc_id % 89 <> 7 THEN '!' ELSE '' END) END AS after
FROM f WHERE doc_id % 97 = 5 OR doc_id % 89 = 7 OR doc_id % 101 = 9""",
)
def inventory_changes(t: Tables):
    """All documents as two stored hash trees, one with changes; compared from their roots."""
    folder = f"{shared_folder(t.spark)}/trees-{uuid.uuid4().hex}"
    docs, k = t.sql(_FILES_OF_DOCS), F.col("doc_id")
    removed, added = k % 97 == 5, (k % 97 != 5) & (k % 89 == 7)
    later = docs.where(~removed).withColumn("text", F.when((k % 101 == 9) & ~added, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    MK.write_tree(_text_files(docs.where(~added)), f"{folder}/old", depth=1)
    MK.write_tree(_text_files(later), f"{folder}/new", depth=1)
    return MK.changes(t.spark, f"{folder}/old", f"{folder}/new", depth=1)
