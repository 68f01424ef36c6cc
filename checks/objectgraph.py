"""Checks of object classification and the relationship graph."""

from pyspark.sql import functions as F

from checks.base import COLUMNS, CONSTRAINT_ROWS, EDGES, FOREIGN_KEYS, OBJECTS, Tables, check, ctes
from checks.catalogs import FINAL
from tableguard.operators import catalog as C, graph as G, objects as O, ruletable as RT
from tableguard.sources.rules import make_rules

CATEGORIES = [
    dict(name="lut", description="Lookup and reference data", prefixes=["LUT_"], comment_keywords=["reference data", "code list"]),
    dict(
        name="um",
        description="User and role access data, red",
        exact_names=["SMALL_RING_3", "um_blue_bolt_2"],
        prefixes=["um_"],
        schemas=["BRAND_3"],
        comment_keywords=["user", "role"],
        column_keywords=["username", "role_id"],
    ),
    dict(
        name="content",
        description="Content and small widget records",
        prefixes=["CONTENT_"],
        schemas=["brand_7"],
        comment_keywords=["publish", "article"],
        column_keywords=["content_id", "body", "published_at"],
    ),
]
OVERRIDES = {"function:brand_2.UM_SMALL_RING_0": "content", "function:brand_17.RED_WIDGET_1": "lut", "table:none.X": "um"}
RULES = make_rules(CATEGORIES, OVERRIDES)


def _list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if len(w) > 1]


def _rule_sql(rule: dict, comment: bool = True) -> str:
    """SELECT of the first-pass match of one rule."""
    name = rule["name"]
    exact = f"list_contains({_list(n.upper() for n in rule.get('exact_names', []))}, upper(object_name))" if rule.get("exact_names") else "false"
    prefix = " OR ".join(f"starts_with(upper(object_name), '{p.upper()}')" for p in rule.get("prefixes", [])) or "false"
    schema = f"list_contains({_list(s.lower() for s in rule.get('schemas', []))}, lower(schema_name))" if rule.get("schemas") else "false"
    said = " OR ".join(f"contains(lower(coalesce(native_comment, '')), '{k}')" for k in rule.get("comment_keywords", [])) if comment else ""
    said = said or "false"
    cases = [(exact, "1.0", "configured_exact", "'exact name ' || upper(object_name)", "true"), (prefix, "0.98", "configured_prefix", "'configured prefix for ' || upper(object_name)", "true"),
             (schema, "0.95", "configured_schema", "'configured schema ' || lower(schema_name)", "true"), (said, "0.72", "comment", "'sanitized native comment'", "false")]
    col = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i] if i != 2 else chr(39) + c[2] + chr(39)}" for c in cases) + " END"
    return f"SELECT object_id, '{name}' AS category, CAST({col(1)} AS DOUBLE) AS confidence, {col(2)} AS kind, {col(3)} AS summary, {col(4)} AS authoritative, 1 AS seq FROM o WHERE ({exact}) OR ({prefix}) OR ({schema}) OR ({said})"


_FIRST = " UNION ALL ".join(_rule_sql(r) for r in CATEGORIES)
_TOP = "row_number() OVER (PARTITION BY object_id ORDER BY confidence DESC, category)"


def _pick(source: str, out: str, confirmed: bool) -> str:
    """Best match per category, ranking and decision as CTEs ending in ``out``."""
    auth = "bool_or(authoritative)" if confirmed else "false"
    return f"""{out}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, category ORDER BY confidence DESC, seq) AS k FROM {source}) WHERE k = 1),
{out}_r AS (SELECT *, {_TOP} AS rn FROM {out}_b),
{out}_a AS (SELECT object_id, {auth} AS sure, count(*) FILTER (authoritative) AS n_sure, max(category) FILTER (authoritative) AS sure_category, max(category) FILTER (rn = 1) AS c1,
 max(confidence) FILTER (rn = 1) AS f1, max(confidence) FILTER (rn = 2) AS f2, string_agg(category || ':' || CAST(CAST(round(confidence * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY rn) AS candidates FROM {out}_r GROUP BY object_id),
{out} AS (SELECT o.object_id, CASE WHEN sure THEN CASE WHEN n_sure = 1 THEN sure_category END WHEN f2 IS NOT NULL AND f1 - f2 < 0.15::DOUBLE THEN NULL ELSE c1 END AS category,
 CASE WHEN a.object_id IS NULL THEN 'final_unresolved' WHEN sure THEN CASE WHEN n_sure = 1 THEN 'final_confirmed' ELSE 'final_unresolved' END WHEN f2 IS NOT NULL AND f1 - f2 < 0.15::DOUBLE THEN 'final_unresolved' ELSE 'final_suggested' END AS status,
 coalesce(candidates, '') AS candidates FROM o LEFT JOIN {out}_a a ON a.object_id = o.object_id)"""


_P1 = f"{ctes(o=OBJECTS)}, first AS ({_FIRST}), {_pick('first', 'p1', False)}"


def _confidence(df):
    return df.withColumn("confidence", F.round(F.col("confidence") * 1000).cast("long"))


def _first(t: Tables):
    return O.pass1(t.sql(OBJECTS), RULES)


# Joins with the parts: as many objects as parts, so they are shuffled, not broadcast.
def _edges(t: Tables):
    return t.sql(EDGES, shuffled=("part",))


def _columns(t: Tables):
    return t.sql(COLUMNS, shuffled=("part",))


def _listed(df):
    parts = F.transform(
        "candidates", lambda c: F.concat(c["category"], F.lit(":"), F.round(c["confidence"] * 1000).cast("long").cast("string"))
    )
    return df.withColumn("candidates", F.array_join(parts, ","))


_MATCH_OUT = "object_id, category, CAST(round(confidence * 1000) AS BIGINT) AS confidence, kind, summary, authoritative"


@check("rule_matches", f"{_P1} SELECT {_MATCH_OUT} FROM first")
def rule_matches(t: Tables):
    return _confidence(O.pass1_matches(t.sql(OBJECTS), RULES)).drop("seq")


@check("rules_as_table", f"{_P1} SELECT {_MATCH_OUT} FROM first")
def rules_as_table(t: Tables):
    """The same matches with the rules in a table."""
    return _confidence(RT.table_matches(t.sql(OBJECTS), RT.rule_table(t.spark, RULES))).drop("seq")


@check("preliminary_pass", f"{_P1} SELECT object_id, category, 'preliminary' AS status, candidates FROM p1")
def preliminary_pass(t: Tables):
    return _listed(_first(t))


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 1))"


_KEYWORDS = " UNION ALL ".join(
    f"SELECT '{r['name']}' AS category, unnest({_list(sorted({w for k in r['column_keywords'] for w in _words(k)}))}) AS word" for r in CATEGORIES if r.get("column_keywords")
)
_OVERLAP = f"""words AS (SELECT DISTINCT object_id, unnest({_tokens('column_name')}) AS word FROM c), kw AS ({_KEYWORDS}),
overlap AS (SELECT object_id, category, least(0.88::DOUBLE, 0.65::DOUBLE + 0.05::DOUBLE * count(*)) AS confidence, 'columns' AS kind, 'column shape: ' || string_agg(word, ', ' ORDER BY word) AS summary, false AS authoritative, 2 AS seq
 FROM words JOIN kw USING (word) GROUP BY object_id, category)"""


@check("column_overlap", f"{ctes(c=COLUMNS)}, {_OVERLAP} SELECT {_MATCH_OUT} FROM overlap")
def column_overlap(t: Tables):
    return _confidence(O.column_overlap(t.sql(COLUMNS), RULES)).drop("seq")


_SIMILAR = " UNION ALL ".join(
    f"""SELECT object_id, '{r['name']}' AS category, len(list_intersect({_tokens('object_name')}, {_list(sorted(set(_words(r['name'] + ' ' + r['description']))))}))::DOUBLE
 / greatest(1, len(list_distinct(list_concat({_tokens('object_name')}, {_list(sorted(set(_words(r['name'] + ' ' + r['description']))))})))) AS s FROM o"""
    for r in CATEGORIES
)
_SIM = f"sim AS ({_SIMILAR}), similar_names AS (SELECT object_id, category, least(0.70::DOUBLE, 0.50::DOUBLE + s / 2) AS confidence, 'token_similarity' AS kind, 'name token similarity' AS summary, false AS authoritative, 3 AS seq FROM sim WHERE s >= 0.25)"


@check("name_similarity", f"{ctes(o=OBJECTS)}, {_SIM} SELECT {_MATCH_OUT} FROM similar_names")
def name_similarity(t: Tables):
    return _confidence(O.name_similarity(t.sql(OBJECTS), RULES)).drop("seq")


_VOTE = """both_ways AS (SELECT source_object_id AS object_id, target_object_id AS other, edge_type FROM e UNION ALL SELECT target_object_id, source_object_id, edge_type FROM e),
vote AS (SELECT b.object_id, min(p.category) AS category, 0.80::DOUBLE AS confidence, CASE WHEN bool_or(edge_type IN ('routine_read', 'routine_write', 'routine_call')) THEN 'routine_dependency' ELSE 'foreign_key_neighborhood' END AS kind,
 'single-category dependency neighborhood' AS summary, false AS authoritative, 4 AS seq FROM both_ways b LEFT JOIN p1 p ON p.object_id = b.other GROUP BY b.object_id HAVING count(DISTINCT p.category) = 1)"""
_EDGED = f"{ctes(o=OBJECTS, e=EDGES)}, first AS ({_FIRST}), {_pick('first', 'p1', False)}, {_VOTE}"


@check("neighbourhood_vote", f"{_EDGED} SELECT {_MATCH_OUT} FROM vote")
def neighbourhood_vote(t: Tables):
    return _confidence(O.neighbour_vote(_edges(t), _first(t))).drop("seq")


# Sample pages: the column names of objects that have some.
_SAMPLES = f"select object_id, string_agg(column_name, ' ') as names from ({COLUMNS}) x group by object_id"
_SHAPES = " UNION ALL ".join(
    f"SELECT object_id, '{r['name']}' AS category, 0.68::DOUBLE AS confidence, 'sample_shape' AS kind, 'sanitized sample column shape' AS summary, false AS authoritative, 5 AS seq FROM s WHERE "
    + " OR ".join(f"contains(lower(names), '{k}')" for k in r["column_keywords"])
    for r in CATEGORIES
    if r.get("column_keywords")
)


def _samples(t: Tables):
    return t.sql(_SAMPLES, shuffled=("part",)).select("object_id", F.split("names", " ").alias("columns"))


@check("sample_shapes", f"{ctes(s=_SAMPLES)}, shape AS ({_SHAPES}) SELECT {_MATCH_OUT} FROM shape")
def sample_shapes(t: Tables):
    return _confidence(O.sample_shape(_samples(t), RULES)).drop("seq")


_OVR = ", ".join(f"('{k}', '{v}')" for k, v in OVERRIDES.items())
_ALL = f"""{ctes(o=OBJECTS, e=EDGES, c=COLUMNS, s=_SAMPLES)}, first AS ({_FIRST}), {_pick('first', 'p1', False)}, {_VOTE}, {_OVERLAP}, {_SIM}, shape AS ({_SHAPES}),
ovr AS (SELECT * FROM (VALUES {_OVR}) v(object_id, category)),
owner AS (SELECT object_id, category, 1.0::DOUBLE AS confidence, 'owner_override' AS kind, 'owner-approved persistent override' AS summary, true AS authoritative, 0 AS seq FROM ovr WHERE object_id IN (SELECT object_id FROM o)),
m AS (SELECT * FROM first UNION ALL SELECT * FROM similar_names UNION ALL SELECT * FROM overlap UNION ALL SELECT * FROM vote UNION ALL SELECT * FROM shape UNION ALL SELECT * FROM owner)"""
_FINAL = f"""{_ALL}, {_pick('m', 'p2', True)}, final AS (SELECT p2.object_id, coalesce(v.category, p2.category) AS category, CASE WHEN v.category IS NOT NULL THEN 'final_confirmed' ELSE status END AS status, candidates FROM p2 LEFT JOIN ovr v USING (object_id))"""


def _final(t: Tables):
    objects = t.sql(OBJECTS)
    return O.pass2(objects, _first(t), RULES, _columns(t), _edges(t), _samples(t))


@check("final_pass", f"{_FINAL} SELECT * FROM final")
def final_pass(t: Tables):
    return _listed(_final(t))


@check(
    "evidence",
    f"""{_ALL} SELECT DISTINCT 'ev_' || substr(sha256(object_id || chr(0) || kind || chr(0) || category || chr(0) || summary), 1, 24) AS evidence_id, object_id, kind, substr(summary, 1, 240) AS summary FROM m""",
)
def evidence(t: Tables):
    return O.evidence(O.all_matches(t.sql(OBJECTS), _first(t), RULES, _columns(t), _edges(t), _samples(t)))


@check(
    "classification_changes",
    f"""{_FINAL} SELECT a.object_id, a.category AS pass_1_category, b.category AS pass_2_category, NOT coalesce(a.category IN ('um', 'lut'), false) AND coalesce(b.category IN ('um', 'lut'), false) AS moved_into_selected,
 coalesce(a.category IN ('um', 'lut'), false) AND NOT coalesce(b.category IN ('um', 'lut'), false) AS moved_out_of_selected FROM p1 a JOIN final b USING (object_id)""",
)
def classification_changes(t: Tables):
    return O.changes(_first(t), _final(t), ["um", "lut"])


_ORDERED = "CASE WHEN sure THEN 0 ELSE 0 END"


@check(
    "open_requests",
    f"""{_FINAL}, ev AS (SELECT r.object_id, rn, r.summary FROM p2_r r) SELECT 'clr_' || substr(sha256(f.object_id), 1, 20) AS request_id, f.object_id,
 coalesce((SELECT string_agg(substr(summary, 1, 240), '|' ORDER BY rn) FROM ev WHERE ev.object_id = f.object_id), '') AS sanitized_evidence, coalesce((SELECT string_agg(category, ',' ORDER BY rn) FROM p2_r r WHERE r.object_id = f.object_id), '') AS candidate_categories FROM final f WHERE status <> 'final_confirmed'""",
)
def open_requests(t: Tables):
    final = _final(t)
    known = O.evidence(O.all_matches(t.sql(OBJECTS), _first(t), RULES, _columns(t), _edges(t), _samples(t)))
    rows = O.open_requests(final, known)
    return rows.withColumn("sanitized_evidence", F.array_join("sanitized_evidence", "|")).withColumn(
        "candidate_categories", F.array_join("candidate_categories", ",")
    )


@check(
    "sources_and_tags",
    f"""{_FINAL} SELECT f.object_id, CASE WHEN status = 'final_confirmed' THEN category END AS context,
 CASE WHEN status <> 'final_confirmed' THEN 'unknown' WHEN f.object_id IN (SELECT object_id FROM ovr) THEN 'owner' ELSE 'rule' END AS classification_source,
 CASE WHEN status = 'final_confirmed' THEN least(category, object_type) || ',' || greatest(category, object_type) ELSE '' END AS tags FROM final f JOIN o USING (object_id)""",
)
def sources_and_tags(t: Tables):
    return O.source_and_tags(_final(t), t.sql(OBJECTS)).withColumn("tags", F.array_join("tags", ","))


_OVERRIDE_ROWS = f"select case when object_type = 'procedure' then object_id else 'gone.' || object_id end as object_id, case when length(object_id) % 2 = 0 then 'um' else 'content' end as override from ({OBJECTS}) x"


@check(
    "owner_overrides",
    f"{ctes(f=FINAL, v=_OVERRIDE_ROWS)} SELECT f.object_id, coalesce(override, category) AS category, CASE WHEN override IS NOT NULL THEN 'final_confirmed' ELSE status END AS status FROM f LEFT JOIN v USING (object_id)",
)
def owner_overrides(t: Tables):
    return O.apply_overrides(t.sql(FINAL), t.sql(_OVERRIDE_ROWS))


# Proposals: one per order, citing evidence of the object of its customer number.
_PROPOSALS = f"""select o_orderkey as proposal_id, coalesce(object_id, 'table:gone.' || cast(o_orderkey as string)) as object_id, case o_orderkey % 7 when 0 then 'other' when 1 then 'lut' else 'um' end as category,
 'ev_' || cast(o_custkey as string) as cited, case when o_orderkey % 5 = 0 then 'ev_' || cast(o_custkey + 1 as string) end as cited_too from {{orders}} left join ({OBJECTS}) x on p_partkey = o_custkey"""
_KNOWN = f"select 'ev_' || cast(p_partkey as string) as evidence_id, case when object_name like '%GEAR%' then 'gone.' || object_id else object_id end as object_id from ({OBJECTS}) x"
_MARKED = f"""{ctes(p=_PROPOSALS, k=_KNOWN, o=OBJECTS)}, m AS (SELECT p.proposal_id, p.object_id, p.category, p.object_id IN (SELECT object_id FROM o) AND category IN ('lut', 'um', 'content')
 AND EXISTS (SELECT 1 FROM k WHERE k.evidence_id = p.cited AND k.object_id = p.object_id) AND (cited_too IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.evidence_id = p.cited_too AND k.object_id = p.object_id)) AS accepted FROM p)"""


def _intake(t: Tables):
    rows = t.sql(_PROPOSALS).withColumn("evidence_ids", F.array_compact(F.array("cited", "cited_too")))
    return O.intake(rows, t.sql(OBJECTS), t.sql(_KNOWN), RULES.names)


@check("proposal_intake", f"{_MARKED} SELECT proposal_id, object_id, category, accepted FROM m")
def proposal_intake(t: Tables):
    return _intake(t).select("proposal_id", "object_id", "category", "accepted")


@check("proposal_counts", f"{_MARKED} SELECT count(*) FILTER (accepted) AS accepted_as_suggestion, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (accepted) AS requires_owner_resolution FROM m")
def proposal_counts(t: Tables):
    return O.intake_counts(_intake(t))


_HEADERS = f"select object_id, schema_name, object_name, object_type, case when object_type = 'function' then 'confirmed' else 'unresolved' end as classification_status, case when object_type = 'function' then 'owner' else 'unknown' end as classification_source, case when object_type = 'function' then 'kept' end as context, cast(null as string) as description from ({OBJECTS}) x"
_RULED = " UNION ALL ".join(_rule_sql(r, comment=False) for r in CATEGORIES)


@check(
    "corpus_classes",
    f"""{ctes(h=_HEADERS)}, o AS (SELECT * FROM h), m AS ({_RULED}), g AS (SELECT object_id, count(*) AS n, min(category) AS category, string_agg('rule:' || kind || ':' || category, ',' ORDER BY 'rule:' || kind || ':' || category) AS evidence FROM m GROUP BY object_id),
d AS (SELECT * FROM (VALUES {', '.join(f"('{r['name']}', '{r['description']}')" for r in CATEGORIES)}) v(category, description))
SELECT h.object_id, CASE WHEN classification_status = 'unresolved' AND n = 1 THEN g.category ELSE h.context END AS context, CASE WHEN classification_status = 'unresolved' AND n = 1 THEN d.description END AS description,
 CASE WHEN classification_status = 'unresolved' THEN coalesce(evidence, '') ELSE '' END AS evidence, CASE WHEN n = 1 THEN 'confirmed' ELSE classification_status END AS classification_status,
 CASE WHEN classification_status = 'unresolved' AND n = 1 THEN 'rule' ELSE classification_source END AS classification_source FROM h LEFT JOIN g USING (object_id) LEFT JOIN d ON d.category = g.category""",
)
def corpus_classes(t: Tables):
    none = F.array().cast("array<string>")
    rows = O.classify_corpus(t.sql(_HEADERS).withColumn("tags", none).withColumn("evidence", none), RULES)
    return rows.select("object_id", "context", "description", F.array_join("evidence", ",").alias("evidence"), "classification_status", "classification_source")


# Graph ----------------------------------------------------------------------------------------

_PLAN = f"pl AS (SELECT o.object_id, f.category AS fc, coalesce(CASE WHEN f.object_id IS NOT NULL THEN f.category ELSE split_part(lower(o.object_name), '_', 1) END IN ('lut', 'um'), false) AS included FROM o LEFT JOIN f USING (object_id)), inside AS (SELECT object_id FROM pl WHERE included)"
_CONF = "conf AS (SELECT object_id, category FROM f WHERE status = 'final_confirmed' AND category IS NOT NULL AND object_id IN (SELECT object_id FROM o))"
_GRAPH = f"{ctes(o=OBJECTS, f=FINAL, c=COLUMNS, fk=FOREIGN_KEYS, cr=CONSTRAINT_ROWS, e=EDGES)}, {_PLAN}, {_CONF}"


def _plan(t: Tables):
    return C.plan(t.sql(OBJECTS), t.sql(FINAL), "selected", ["um"])


def _fks(t: Tables):
    return t.sql(FOREIGN_KEYS).withColumn("source_columns", F.array("source_column")).withColumn("target_columns", F.array("target_column"))


@check(
    "graph_nodes",
    f"""{_GRAPH} SELECT 'database:lake' AS id, 'database' AS type, 'lake' AS name, NULL AS schema, NULL AS data_type, NULL AS materialized
UNION ALL SELECT DISTINCT 'schema:' || schema_name, 'schema', schema_name, NULL, NULL, NULL FROM o
UNION ALL SELECT DISTINCT 'category:' || category, 'category', category, NULL, NULL, NULL FROM conf
UNION ALL SELECT object_id, object_type, object_name, schema_name, NULL, object_id IN (SELECT object_id FROM inside) FROM o
UNION ALL SELECT object_id || ':column:' || column_name, 'column', column_name, NULL, data_type, NULL FROM c""",
)
def graph_nodes(t: Tables):
    return G.nodes(t.sql(OBJECTS), t.sql(COLUMNS), t.sql(FINAL), _plan(t), "lake")


_FLAG = "(source IN (SELECT object_id FROM inside)) <> (target IN (SELECT object_id FROM inside))"


@check(
    "graph_edges",
    f"""{_GRAPH}, pk AS (SELECT DISTINCT cr.object_id, cr.column_name FROM cr WHERE lower(constraint_type) <> 'unique'),
links AS (SELECT source_object_id AS source, target_object_id AS target, 'FOREIGN_KEY' AS type FROM fk UNION SELECT source_object_id, target_object_id, CASE edge_type WHEN 'routine_read' THEN 'READS_FROM' ELSE 'WRITES_TO' END FROM e WHERE edge_type <> 'foreign_key')
SELECT 'database:lake' AS source, 'schema:' || schema_name AS target, 'CONTAINS' AS type, false AS boundary_only FROM o
UNION SELECT 'schema:' || schema_name, object_id, 'CONTAINS', false FROM o
UNION SELECT object_id, 'category:' || category, 'BELONGS_TO_CATEGORY', false FROM conf
UNION SELECT object_id, object_id || ':column:' || column_name, 'HAS_COLUMN', false FROM c
UNION SELECT c.object_id, c.object_id || ':column:' || c.column_name, 'PRIMARY_KEY', false FROM c JOIN pk ON pk.object_id = c.object_id AND upper(pk.column_name) = c.column_name
UNION SELECT source, target, type, {_FLAG} FROM links""",
)
def graph_edges(t: Tables):
    constraints = C.group_constraints(t.sql(CONSTRAINT_ROWS).withColumn("column_name", F.upper("column_name")))
    return G.edges(t.sql(OBJECTS), t.sql(COLUMNS), constraints, t.sql(FINAL), _fks(t), t.sql(EDGES), _plan(t), "lake")


@check(
    "graph_relationships",
    f"""{_GRAPH}, ks AS (SELECT object_id, constraint_name, lower(constraint_type) AS kind, string_agg(lower(column_name), ',' ORDER BY lower(column_name)) AS cols FROM cr GROUP BY ALL),
two AS (SELECT source_object_id, count(*) AS n, string_agg(DISTINCT lower(source_column), ',' ORDER BY lower(source_column)) AS cols FROM fk GROUP BY source_object_id)
SELECT fk.name, fk.source_object_id AS source, fk.target_object_id AS target, fk.source_column AS source_columns, fk.target_column AS target_columns,
 CASE WHEN EXISTS (SELECT 1 FROM two JOIN ks ON ks.object_id = two.source_object_id AND ks.kind = 'primary key' AND ks.cols = two.cols WHERE two.source_object_id = fk.source_object_id AND two.n = 2) THEN 'M:N'
  WHEN EXISTS (SELECT 1 FROM ks WHERE ks.object_id = fk.source_object_id AND ks.cols = lower(fk.source_column)) THEN '1:1' ELSE '1:N' END AS cardinality,
 CASE WHEN fk.target_object_id IN (SELECT object_id FROM o) THEN 'confirmed' ELSE 'unknown' END AS confidence, fk.target_object_id IN (SELECT object_id FROM o) AS target_resolved,
 (fk.source_object_id IN (SELECT object_id FROM inside)) <> (fk.target_object_id IN (SELECT object_id FROM inside)) AS boundary_only FROM fk""",
)
def graph_relationships(t: Tables):
    rows = G.relationships(_fks(t), C.group_constraints(t.sql(CONSTRAINT_ROWS)), t.sql(OBJECTS), _plan(t))
    return rows.withColumn("source_columns", F.array_join("source_columns", ",")).withColumn("target_columns", F.array_join("target_columns", ","))


@check("boundary_edges", f"{_GRAPH}, l AS (SELECT source_object_id AS source, target_object_id AS target, edge_type FROM e) SELECT edge_type, {_FLAG} AS boundary_only, count(*) AS n FROM l GROUP BY ALL")
def boundary_edges(t: Tables):
    links = t.sql(EDGES).select(F.col("source_object_id").alias("source"), F.col("target_object_id").alias("target"), "edge_type")
    return G.boundary(links, _plan(t)).groupBy("edge_type", "boundary_only").agg(F.count(F.lit(1)).alias("n"))


_DEPS = f"select source_object_id, case when length(source_object_id) % 4 = 0 then target_object_id || '_old' else target_object_id end as target_object_id, edge_type from ({EDGES}) y"


@check(
    "routine_dependencies",
    f"{ctes(o=OBJECTS, d=_DEPS)} SELECT source_object_id, edge_type, target_object_id IN (SELECT object_id FROM o) AS target_resolved, count(*) AS n FROM d WHERE edge_type <> 'foreign_key' GROUP BY ALL",
)
def routine_dependencies(t: Tables):
    rows = G.routine_dependencies(t.sql(_DEPS), t.sql(OBJECTS))
    return rows.groupBy("source_object_id", "edge_type", "target_resolved").agg(F.count(F.lit(1)).alias("n"))


@check(
    "object_index",
    f"{_GRAPH} SELECT o.object_id, schema_name AS schema, object_name AS name, object_type, conf.category, o.object_id IN (SELECT object_id FROM inside) AS materialized, modified_at AS content_hash, CASE WHEN conf.category IS NULL THEN object_type ELSE conf.category || ',' || object_type END AS tags FROM o LEFT JOIN conf USING (object_id)",
)
def object_index(t: Tables):
    objects = t.sql(OBJECTS).withColumn("source_fingerprint", F.col("modified_at"))
    index = G.object_index(objects, t.sql(FINAL), _plan(t))
    return index.join(G.tags(index), "object_id").withColumn("tags", F.array_join("tags", ","))


@check("fk_edges", f"{ctes(fk=FOREIGN_KEYS)} SELECT source_object_id, target_object_id, 'foreign_key' AS edge_type, name AS evidence FROM fk")
def fk_edges(t: Tables):
    return G.fk_edges(_fks(t)).withColumn("evidence", F.array_join("evidence", ","))


def _cardinality_sql(child: str, parent: str, ck: str, pk: str) -> str:
    return f"""WITH k AS (SELECT {ck} AS k, count(*) AS n FROM {child} WHERE {ck} IS NOT NULL GROUP BY 1), p AS (SELECT {pk} AS k, count(*) AS m FROM {parent} GROUP BY 1), j AS (SELECT k.k, n, m FROM k LEFT JOIN p ON p.k = k.k),
s AS (SELECT CAST(sum(n) AS BIGINT) AS child_rows, count(*) AS child_keys, max(n) AS max_children, coalesce(max(m), 0) AS max_parents, count(*) FILTER (m IS NULL) AS orphan_keys FROM j)
SELECT *, CASE WHEN max_parents > 1 THEN 'M:N' WHEN max_children <= 1 THEN '1:1' ELSE '1:N' END AS cardinality FROM s"""


@check("cardinality_lineitem_orders", _cardinality_sql("lineitem", "orders", "l_orderkey", "o_orderkey"))
def cardinality_lineitem_orders(t: Tables):
    return G.infer_cardinality(t.lineitem, t.orders, ["l_orderkey"], ["o_orderkey"])


@check("cardinality_labels_documents", _cardinality_sql("labels", "documents", "doc_id", "doc_id"))
def cardinality_labels_documents(t: Tables):
    return G.infer_cardinality(t.labels, t.documents, ["doc_id"], ["doc_id"])


@check("cardinality_parts_items", _cardinality_sql("lineitem", "lineitem", "l_suppkey", "l_partkey"))
def cardinality_parts_items(t: Tables):
    return G.infer_cardinality(t.lineitem, t.lineitem, ["l_suppkey"], ["l_partkey"])


@check("orphan_keys", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END FROM customer) GROUP BY o_custkey")
def orphan_keys(t: Tables):
    parents = t.customer.select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("c_custkey"))
    return G.orphan_keys(t.orders, parents, ["o_custkey"], ["c_custkey"])
