"""Checks that write with a sink and read back what is there."""

from pyspark.sql import functions as F

from checks.base import OBJECTS, Tables, check, ctes, duck
from checks.catalogs import FINAL
from checks.selects import _ARRIVING, _arrivals, _drain, _event_stream, _run_folder
from tableguard.operators import catalog as C
from tableguard.sources import catalog as SC, footers as FT, tables as ST
from tableguard.streaming import bucketed as BK, stateful as SF, streams as SS

_ROWS = "select event_id, event_type, user_id, case when user_id % 7 = 0 then null else props end as props from {events}"


@check("json_lines", f"{ctes(e=_ROWS)} SELECT * FROM e")
def json_lines(t: Tables):
    folder = _run_folder(t)
    ST.write_json_lines(t.sql(_ROWS), folder)
    return t.spark.read.schema("event_id long, event_type string, user_id long, props string").json(folder)


_CATEGORISED = f"select o.object_id, o.object_type, f.category from ({OBJECTS}) o left join ({FINAL}) f on f.object_id = o.object_id"


@check(
    "materialized_objects",
    f"{ctes(o=_CATEGORISED)} SELECT object_id, coalesce(category, 'unknowns') AS category, CASE object_type WHEN 'table' THEN 'tables' WHEN 'function' THEN 'functions' ELSE 'store_procedures' END AS folder FROM o",
)
def materialized_objects(t: Tables):
    folder = _run_folder(t)
    ST.materialize(t.sql(_CATEGORISED), folder)
    return t.spark.read.parquet(folder).select("object_id", "category", "folder")


@check("written_index", "SELECT c_custkey AS id, c_name AS name, 3 AS version FROM customer")
def written_index(t: Tables):
    root = _run_folder(t)
    ST.write_index(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), root, 3)
    return t.spark.read.parquet(root).select("id", "name", F.col("version").cast("int").alias("version"))


_LINES = "select lang, replace(replace(coalesce(text, ''), chr(10), ' '), chr(13), ' ') as line from {documents}"


@check("corpus_files", f"{ctes(d=_LINES)} SELECT lang, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM d GROUP BY lang")
def corpus_files(t: Tables):
    """Every document as a line of a file of its language, read back as whole files."""
    folder = _run_folder(t)
    t.sql(_LINES).write.partitionBy("lang").text(folder)
    files = ST.read_sql_corpus(t.spark, folder, "*.txt").where("problem is null")
    lines = files.select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@check("written_sample", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders ORDER BY orders.o_orderkey LIMIT 20")
def written_sample(t: Tables):
    folder = _run_folder(t)
    ST.write_sample(C.sample(t.orders, 20, primary=["o_orderkey"]).select("o_orderkey", "o_orderstatus"), folder)
    return t.spark.read.option("header", "true").csv(folder)


@check("lake_columns", " UNION ALL ".join(f"SELECT '{n}' AS table_name, column_name FROM (DESCRIBE {n})" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def lake_columns(t: Tables):
    """Columns of all tables, from the files' footers."""
    return SC.read_lake_catalog(t.spark, t.sf)["columns"].select("table_name", "column_name")


_USERS = """select 'app' as schema_name, 'user_' || cast(user_id as string) as object_name, 'table' as object_type, case when user_id % 2 = 0 then 'um' end as context,
 'about user ' || cast(user_id as string) as description, cast(null as string) as classification_status, 'rule' as classification_source, 'sha256:' || cast(user_id as string) as source_fingerprint,
 cast(null as string) as content_hash, 'um/user.sql' as managed_relative_path, 1 as header_version, '2' as output_format_version, ts as submitted_at from {events}"""


@check("indexed_stream", f"{ctes(u=_USERS)} SELECT DISTINCT object_name, context, description, source_fingerprint, true AS active FROM u")
def indexed_stream(t: Tables):
    """Index entries from a stream of events; every trigger writes the identities it names."""
    root = _run_folder(t)
    none = F.array().cast("array<string>")
    stream = _event_stream(t).selectExpr(*[c.strip() for c in _columns(_USERS)]).withColumn("tags", none).withColumn("evidence", none)
    _drain(stream, root, "append", SS.index_sink(root))
    return SS.read_index(t.spark, root).select("object_name", "context", "description", "source_fingerprint", "active")


_OWNED_USERS = """select 'app' as schema_name, 'user_' || cast(user_id as string) as object_name, 'table' as object_type, 'v' || cast(arrival as string) as context,
 'about ' || event_type as description, cast(null as string) as classification_status, case when user_id % 3 = 0 and arrival = 1 then 'owner' else 'rule' end as classification_source,
 'sha256:' || cast(arrival as string) as source_fingerprint, cast(null as string) as content_hash, 'um/user.sql' as managed_relative_path, 1 as header_version, '2' as output_format_version, cast(ts as timestamp) as submitted_at, arrival
 from ({inner}) as a where (user_id + arrival) % 2 = 0 or user_id % 3 = 0"""


@check(
    "bucketed_stream",
    f"""WITH u AS ({duck(_OWNED_USERS.replace('{inner}', _ARRIVING))}), k AS (SELECT object_name, arrival, arg_max(context, submitted_at) AS context, arg_max(classification_source, submitted_at) AS src FROM u GROUP BY ALL),
o AS (SELECT object_name, max(arrival) AS last, max(arrival) FILTER (src = 'owner') AS owner FROM k GROUP BY object_name)
SELECT o.object_name, 'v' || CAST(coalesce(owner, last) AS VARCHAR) AS context, CASE WHEN owner IS NULL THEN 'rule' ELSE 'owner' END AS classification_source, 'sha256:' || CAST(last AS VARCHAR) AS source_fingerprint, true AS active FROM o""",
)
def bucketed_stream(t: Tables):
    """Four batches into an index laid out by hash; what owners said stays. The last batch comes twice."""
    folder = _run_folder(t)
    none = F.array().cast("array<string>")
    rows = t.sql(_OWNED_USERS.replace("{inner}", _ARRIVING)).withColumn("tags", none).withColumn("evidence", none)
    stream, bring = _arrivals(t, rows, folder)
    sink, seen = BK.bucketed_sink(f"{folder}/index", buckets=64, most_parts=2), {}

    def apply(df, batch_id):
        df.write.mode("overwrite").parquet(f"{folder}/replayed")
        seen["last"] = batch_id
        sink(df, batch_id)

    bring(lambda: _drain(stream, folder, "append", apply))
    sink(t.spark.read.parquet(f"{folder}/replayed"), seen["last"])
    return BK.read_bucketed(t.spark, f"{folder}/index").select("object_name", "context", "classification_source", "source_fingerprint", "active")


def _columns(sql: str) -> list[str]:
    """Expressions of a SELECT without commas inside calls other than casts."""
    body = sql[len("select ") : sql.index(" from {")].replace("\n", " ")
    out, depth, at = [], 0, 0
    for i, c in enumerate(body):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(body[at:i])
            at = i + 1
    return [*out, body[at:]]


_LATE = "select ts as occurred_at, event_type as operation, case when value < 5 then 'refused' else 'succeeded' end as outcome, event_type = 'error' as failed, cast(floor(value) as bigint) as duration_ms from {events}"


@check(
    "audit_windows_appended",
    f"""{ctes(a=_LATE)}, w AS (SELECT time_bucket(INTERVAL '6 hours', occurred_at) AS window_start, * FROM a)
SELECT window_start, window_start + INTERVAL '6 hours' AS window_end, operation, outcome, count(*) AS n, count(*) FILTER (failed) AS failures, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
FROM w WHERE window_start + INTERVAL '6 hours' <= (SELECT max(occurred_at) FROM a) - INTERVAL '12 hours' GROUP BY ALL""",
)
def audit_windows_appended(t: Tables):
    """The roll-up in append mode: only windows that the watermark has closed come out."""
    folder = _run_folder(t)
    events = _event_stream(t).select(
        F.col("ts").alias("occurred_at"), F.col("event_type").alias("operation"), F.when(F.col("value") < 5, "refused").otherwise("succeeded").alias("outcome"),
        (F.col("event_type") == "error").alias("failed"), F.floor("value").alias("duration_ms"),
    )
    rolled = SS.audit_rollup(events, window="6 hours", watermark="12 hours")
    _drain(rolled, folder, "append", lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}"))
    return t.spark.read.schema(rolled.schema).parquet(f"{folder}/out").select(*rolled.columns)


_LATE_ARRIVING = f"select cast(ts as timestamp) as occurred_at, event_type as operation, case when value < 5 then 'refused' else 'succeeded' end as outcome, event_type = 'error' as failed, cast(floor(value) as bigint) as duration_ms, arrival from ({_ARRIVING}) as a"


@check(
    "audit_windows_late",
    f"""WITH a AS ({duck(_LATE_ARRIVING)}), heads AS (SELECT arrival + 1 AS arrival, max(max(occurred_at)) OVER (ORDER BY arrival) - INTERVAL 12 HOUR AS mark FROM a GROUP BY arrival),
w AS (SELECT time_bucket(INTERVAL '6 hours', occurred_at) AS window_start, a.*, mark FROM a LEFT JOIN heads USING (arrival))
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, operation, outcome, count(*) AS n, count(*) FILTER (failed) AS failures, CAST(sum(duration_ms) AS BIGINT) AS duration_ms
FROM w WHERE (mark IS NULL OR window_start + INTERVAL 6 HOUR > mark) AND window_start + INTERVAL 6 HOUR <= (SELECT max(mark) FROM heads) GROUP BY ALL""",
)
def audit_windows_late(t: Tables):
    """The roll-up over four arrivals; events behind the watermark are dropped, those before it count."""
    folder = _run_folder(t)
    stream, bring = _arrivals(t, t.sql(_LATE_ARRIVING), folder)
    return bring(SF.as_table(SS.audit_rollup(stream, window="6 hours", watermark="12 hours"), folder)).drop("batch")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@check("footer_sizes", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in _TABLES))
def footer_sizes(t: Tables):
    """Rows of all tables, from the files' footers in one job."""
    return FT.table_sizes(t.spark, t.sf).select("table_name", "rows")


@check("footer_nulls", " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS nulls FROM {n}" for n, c in (("orders", "o_custkey"), ("customer", "c_name"), ("events", "event_type"), ("documents", "lang"), ("labels", "toxic"), ("conversations", "text"))))
def footer_nulls(t: Tables):
    rows = FT.column_bounds(t.spark, t.sf, protected=("c_name",)).select("table_name", "column_name", "nulls")
    pairs = F.concat_ws(".", "table_name", "column_name").isin("orders.o_custkey", "customer.c_name", "events.event_type", "documents.lang", "labels.toxic", "conversations.text")
    return rows.where(pairs)
