"""Managed SQL files as a table: headers, identities, folder plans and drift."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableguard.functions import fixed as X
from tableguard.functions.values import as_col, java
from tableguard.operators.fingerprints import joined, sealed_digest, sha256_text
from tableguard.operators.objects import classify_corpus
from tableguard.operators.spread import spread_left_join
from tableguard.session import cut_lineage
from tableguard.sources.rules import Rules

DEFAULT_PREFIX = "-- context: "
#: Most clashes of a folder plan that are broadcast (some 300 bytes each); more are joined by a shuffle.
CLASHES = 100_000

# Header fields in the order they are written (sorted keys).
HEADER = T.StructType(
    [
        T.StructField("classification_source", T.StringType()),
        T.StructField("classification_status", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("header_version", T.IntegerType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("object_name", T.StringType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("output_format_version", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("source_fingerprint", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
_REQUIRED = (
    "object_id engine schema_name object_name object_type classification_status "
    "classification_source content_hash output_format_version"
).split()
# Engines a header may name.
ENGINES = ("sqlserver", "postgres", "postgresql", "mysql", "mariadb", "oracle", "parquet")


def header_line(header: Column | None = None, prefix: str = DEFAULT_PREFIX) -> Column:
    """One comment line holding the header as compact JSON with sorted keys."""
    h = header if header is not None else F.struct(*[F.col(f.name) for f in HEADER.fields])
    return F.concat(F.lit(prefix), F.to_json(h, {"ignoreNullFields": "false"}))


def render_header(df: DataFrame, body: str = "body", prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Adds ``content``: header line, newline, body. Header fields are columns of ``df``."""
    fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HEADER.fields])
    return df.withColumn("content", F.concat(header_line(fields, prefix), F.lit("\n"), F.col(body)))


def header_problems(h: Column) -> Column:
    """Array of the rules a parsed header breaks."""
    status, source, context = h["classification_status"], h["classification_source"], h["context"]
    tags = F.coalesce(h["tags"], F.array().cast("array<string>"))
    listed = F.coalesce(h["evidence"], F.array().cast("array<string>"))
    expected = F.concat(h["object_type"], F.lit(":"), h["schema_name"], F.lit("."), h["object_name"])
    missing = F.lit(False)
    for f in _REQUIRED:
        missing = missing | h[f].isNull()

    def plain(c: Column) -> Column:
        return F.array_sort(F.array_distinct(c)) == c

    rules = {
        "missing_field": missing,
        "object_id": h["object_id"] != expected,
        "object_type": ~h["object_type"].isin(*X.TYPE_FOLDER),
        "engine": ~h["engine"].isin(*ENGINES),
        "versions": (F.coalesce(h["header_version"], F.lit(1)) != 1)
        | (h["output_format_version"] != X.FILE_FORMAT_VERSION),
        "context": context.isNotNull() & ~context.rlike(X.SAFE_TERM_RE),
        "description": F.length(h["description"]) > 2000,
        "tags": ~plain(tags) | (F.size(tags) > 64) | F.exists(tags, lambda t: ~t.rlike(X.SAFE_TERM_RE)),
        "evidence": ~plain(listed)
        | (F.size(listed) > 64)
        | F.exists(listed, lambda e: (e == "") | e.rlike("[\\x00\\r\\n]")),
        "hashes": F.coalesce(~h["source_fingerprint"].rlike(X.SHA256_RE), F.lit(False))
        | ~h["content_hash"].rlike(X.SHA256_RE),
        "classification": ~status.isin("confirmed", "unresolved")
        | ~source.isin("owner", "rule", "unknown")
        | F.when(status == "unresolved", context.isNotNull() | (F.size(tags) > 0) | (source != "unknown")).otherwise(
            context.isNull() | (source == "unknown")
        ),
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    )


def parse_header(df: DataFrame, content: str = "content", prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Adds ``state`` (ok, missing, invalid), ``header``, ``problems`` and ``body``."""
    c = F.col(content)
    at = F.instr(c, "\n")
    first = F.when(at > 0, F.substring_index(c, "\n", 1))
    has = F.coalesce(first.startswith(prefix), F.lit(False))
    text = F.when(has, F.substr(first, F.lit(len(prefix) + 1)))
    allowed = F.array(*[F.lit(f.name) for f in HEADER.fields])
    staged = df.select("*", has.alias("__tg_has"), text.alias("__tg_text"), at.alias("__tg_at"))
    staged = staged.withColumn("__tg_keys", F.json_object_keys("__tg_text"))
    staged = staged.withColumn("header", F.from_json("__tg_text", HEADER))
    extra = F.size(F.array_except("__tg_keys", allowed)) > 0
    broken = F.col("__tg_has") & (F.col("__tg_keys").isNull() | extra)
    problems = F.when(~F.col("__tg_has"), F.array().cast("array<string>")).when(
        broken, F.array(F.lit("not_a_header"))
    ).otherwise(header_problems(F.col("header")))
    staged = staged.withColumn("problems", problems)
    state = (
        F.when(~F.col("__tg_has"), "missing").when(F.size("problems") > 0, "invalid").otherwise("ok")
    )
    body = F.when(F.col("__tg_has"), F.substr(c, F.col("__tg_at") + 1)).otherwise(c)
    return staged.select(
        *[F.col(x) for x in df.columns],
        state.alias("state"),
        F.when(state == "ok", F.col("header")).alias("header"),
        "problems",
        body.alias("body"),
    )


# Declarations -------------------------------------------------------------------------------

_OPEN = re.compile(r"'(?:[^']|'')*(?:'|\Z)|\"(?:[^\"]|\"\")*(?:\"|\Z)|\[(?:[^\]]|\]\])*(?:\]|\Z)|--[^\n]*|/\*")
_NEST = re.compile(r"/\*|\*/")


def visible_code(sql: str) -> str:
    """SQL with quoted text and (nested) comments blanked out; bracketed names stay."""
    out, at = [], 0
    while m := _OPEN.search(sql, at):
        out.append(sql[at : m.start()])
        end = m.end()
        if m.group()[0] == "[":
            out.append(m.group())
        else:
            depth = 1 if m.group() == "/*" else 0
            while depth:
                n = _NEST.search(sql, end)
                end = n.end() if n else len(sql)
                depth = depth + (1 if n.group() == "/*" else -1) if n else 0
            out.append(" ")
        at = end
    return "".join(out) + sql[at:]


@F.arrow_udf(T.StringType())
def visible(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else visible_code(v) for v in values.to_pylist()], pa.string())


# Shape of an object declaration.
_IDENTIFIER = r"(?:\[(?:[^\]\r\n]|\]\])+\]|[A-Za-z_][A-Za-z0-9_$#@]*)"
DECLARATION_RE = (
    r"\b(?:CREATE\s+OR\s+ALTER|CREATE|ALTER)\s+(TABLE|PROCEDURE|PROC|FUNCTION)\s+"
    rf"({_IDENTIFIER})(?:\s*\.\s*({_IDENTIFIER}))?"
)


def declaration_surface(c: Column | str) -> Column:
    """Visible code of SQL text; only text with quotes, comments or brackets leaves the JVM."""
    c = as_col(c)
    return F.coalesce(visible(F.when(c.rlike("['\"\\[]|--|/\\*"), c)), c)


def _bare(c: Column) -> Column:
    inside = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit("]]"), F.lit("]"))
    return F.when(c.startswith("["), inside).otherwise(c)


def detect_identity(df: DataFrame, sql: str, default_schema: str = "dbo") -> DataFrame:
    """Adds the number of declarations and, when there is exactly one, what it declares."""
    staged = df.withColumn("__tg_code", declaration_surface(sql))
    pattern = java(DECLARATION_RE, "i")
    found = F.regexp_extract_all("__tg_code", F.lit(pattern), F.lit(0))
    staged = staged.withColumn("declarations", F.size(found))
    one = F.col("declarations") == 1
    part = [F.regexp_extract("__tg_code", pattern, g) for g in (1, 2, 3)]
    kind = F.upper(part[0])
    object_type = F.when(kind == "TABLE", "table").when(kind == "FUNCTION", "function").otherwise("procedure")
    has_schema = part[2] != ""
    return staged.select(
        *[F.col(x) for x in df.columns],
        "declarations",
        F.when(one, object_type).alias("declared_type"),
        F.when(one, F.when(has_schema, _bare(part[1])).otherwise(default_schema)).alias("declared_schema"),
        F.when(one, F.when(has_schema, _bare(part[2])).otherwise(_bare(part[1]))).alias("declared_name"),
    )


def check_identity(corpus: DataFrame, engine: str, content: str = "content", prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Files with ``problem``: header against declaration, engine and body hash.

    A file without a header gets an unresolved header built from its declaration.
    """
    rows = detect_identity(parse_header(corpus, content, prefix), "body")
    h = F.col("header")
    ok = F.col("state") == "ok"
    differs = (
        (h["object_type"] != F.col("declared_type"))
        | (F.lower(h["schema_name"]) != F.lower("declared_schema"))
        | (F.lower(h["object_name"]) != F.lower("declared_name"))
    )
    problem = (
        F.when(F.col("state") == "invalid", "MANAGED_SQL_HEADER_INVALID")
        .when(F.col("declarations") != 1, "FOLDER_SQL_OBJECT_COUNT_INVALID")
        .when(ok & differs, "MANAGED_SQL_IDENTITY_MISMATCH")
        .when(ok & (h["engine"] != engine), "MANAGED_SQL_ENGINE_MISMATCH")
        .when(ok & (h["content_hash"] != sha256_text("body")), "MANAGED_SQL_CONTENT_DRIFT")
    )
    none = F.lit(None).cast("string")
    fresh = {
        "classification_source": F.lit("unknown"),
        "classification_status": F.lit("unresolved"),
        "content_hash": sha256_text("body"),
        "context": none,
        "description": none,
        "engine": F.lit(engine),
        "evidence": F.array().cast("array<string>"),
        "header_version": F.lit(1),
        "object_id": F.concat(
            F.col("declared_type"), F.lit(":"), F.col("declared_schema"), F.lit("."), F.col("declared_name")
        ),
        "object_name": F.col("declared_name"),
        "object_type": F.col("declared_type"),
        "output_format_version": F.lit(X.FILE_FORMAT_VERSION),
        "schema_name": F.col("declared_schema"),
        "source_fingerprint": none,
        "tags": F.array().cast("array<string>"),
    }
    built = F.struct(*[c.cast(HEADER[n].dataType).alias(n) for n, c in fresh.items()])
    return rows.select(
        *[F.col(x) for x in corpus.columns],
        F.when(ok, h).otherwise(built).alias("header"),
        "body",
        problem.alias("problem"),
    )


def folder_plan(
    corpus: DataFrame,
    rules: Rules,
    engine: str,
    resolutions: DataFrame | None = None,
    in_place: bool = False,
    prefix: str = DEFAULT_PREFIX,
) -> DataFrame:
    """Plan of a folder: class, destination, hashes and ``problem`` per file.

    ``corpus`` has ``path, content``; ``resolutions`` has ``path, context, description, tags`` set
    by the owner. Duplicate identities and colliding destinations are counted over keys alone: only
    path, keys and own problem of each file are stored, no text. The files are then read a second
    time, meet the clashes (broadcast up to ``CLASHES`` of them), and are rendered last.
    """
    checked = check_identity(corpus, engine, prefix=prefix)
    flat = checked.select("path", "content", "body", "problem", "header.*")
    ruled = classify_corpus(flat, rules)
    if resolutions is not None:
        r = resolutions.select(
            F.lower("path").alias("r_path"),
            F.col("context").alias("r_context"),
            F.col("description").alias("r_description"),
            F.array_sort(F.array_distinct("tags")).alias("r_tags"),
        )
        ruled = ruled.join(r, F.lower("path") == F.col("r_path"), "left")
        hit = F.col("r_path").isNotNull()
        new = {
            "context": F.col("r_context"),
            "description": F.col("r_description"),
            "tags": F.col("r_tags"),
            "classification_status": F.lit("confirmed"),
            "classification_source": F.lit("owner"),
        }
        ruled = ruled.select(
            *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in flat.columns]
        )
    sure = F.col("classification_status") == "confirmed"
    folder = F.create_map(*[F.lit(x) for pair in X.TYPE_FOLDER.items() for x in pair])
    destination = F.concat_ws(
        "/",
        F.when(sure, F.col("context")).otherwise("unknowns"),
        folder[F.col("object_type")],
        F.substring_index("path", "/", -1),
    )
    rows = ruled.withColumn("destination", destination)
    rows = rows.withColumn("input_hash", sha256_text("content"))
    rows = rows.withColumn("id_key", F.lower("object_id")).withColumn("dest_key", F.lower("destination"))
    clashes = cut_lineage(_clashes(cut_lineage(rows.select("path", "id_key", "dest_key", "problem")), in_place))
    found = clashes if clashes.count() > CLASHES else F.broadcast(clashes)
    same = F.lit(True)
    for c in ("path", "id_key", "dest_key"):
        same = same & F.col(c).eqNullSafe(F.col(f"__tg_{c}"))
    problem = F.coalesce("problem", "__tg_clash")
    header = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HEADER.fields])
    out = rows.join(found, same, "left").withColumn("rendered", F.concat(header_line(header, prefix), F.lit("\n"), F.col("body")))
    return out.withColumn("output_hash", sha256_text("rendered")).select(
        "path",
        "destination",
        "object_id",
        "object_type",
        "classification_status",
        "context",
        "tags",
        "evidence",
        "input_hash",
        "output_hash",
        header.alias("header"),
        "rendered",
        problem.alias("problem"),
    )


def _clashes(keys: DataFrame, in_place: bool) -> DataFrame:
    """Path, keys and problem of the files that no problem of their own keeps out but another file does.

    ``keys`` has ``path, id_key, dest_key, problem`` and may be read several times.
    """
    sound = keys.where(F.col("problem").isNull()).drop("problem")

    def repeated(name: str) -> DataFrame:
        counted = sound.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        return counted.where("n > 1").select(name, F.lit(True).alias(f"{name}_twice"))

    out = spread_left_join(spread_left_join(sound, repeated("id_key"), "id_key"), repeated("dest_key"), "dest_key")
    clash = F.when(F.col("id_key_twice"), "FOLDER_DUPLICATE_OBJECT_IDENTITY").when(F.col("dest_key_twice"), "FOLDER_DESTINATION_COLLISION")
    if in_place:
        sources = keys.select(F.lower("path").alias("dest_key")).distinct().withColumn("taken", F.lit(True))
        out = spread_left_join(out, sources, "dest_key")
        clash = clash.when(F.col("taken") & (F.col("dest_key") != F.lower("path")), "FOLDER_IN_PLACE_SOURCE_COLLISION")
    told = [F.col(c).alias(f"__tg_{c}") for c in ("path", "id_key", "dest_key")]
    return out.select(*told, clash.alias("__tg_clash")).where("__tg_clash is not null").distinct()


def unused_resolutions(corpus: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Owner resolutions whose file does not exist."""
    paths = corpus.select(F.lower("path").alias("key")).distinct()
    return resolutions.withColumn("key", F.lower("path")).join(paths, "key", "left_anti").drop("key")


def corpus_drift(plan: DataFrame, corpus: DataFrame, manifest: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Applied plan rows whose file, manifest row or header no longer agrees, with the reason.

    ``corpus`` holds the files at their destinations, ``manifest`` has ``path, sha256``.
    """
    files = parse_header(corpus, "content", prefix).select(
        F.lower("path").alias("dest_key"), sha256_text("content").alias("now"), F.col("header").alias("h_now")
    )
    listed = manifest.groupBy(F.lower("path").alias("dest_key")).agg(
        F.max("sha256").alias("listed"), F.count(F.lit(1)).alias("listed_n")
    )
    rows = (
        plan.withColumn("dest_key", F.lower("destination"))
        .join(files, "dest_key", "left")
        .join(listed, "dest_key", "left")
    )
    reason = (
        F.when(F.col("now").isNull(), "file_missing")
        .when(F.col("now") != F.col("output_hash"), "file_changed")
        .when(F.col("listed").isNull(), "not_in_manifest")
        .when(F.col("listed_n") > 1, "listed_twice")
        .when(F.col("listed") != F.col("output_hash"), "manifest_differs")
        .when(~F.to_json("h_now").eqNullSafe(F.to_json("header")), "header_changed")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("destination", "object_id", "reason")


def input_drift(plan: DataFrame, corpus: DataFrame) -> DataFrame:
    """Plan rows whose source file changed or vanished since planning."""
    now = corpus.select("path", sha256_text("content").alias("now"))
    rows = plan.join(now, "path", "left")
    return rows.where(~F.col("now").eqNullSafe(F.col("input_hash"))).select("path", "object_id")


def replace_in_manifest(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """Manifest after a single-file resolution: its old and new path leave, its new row enters."""
    gone = plan.select(F.explode(F.array(F.lower("path"), F.lower("destination"))).alias("key")).distinct()
    kept = manifest.withColumn("key", F.lower("path")).join(gone, "key", "left_anti").select("path", "sha256")
    return kept.unionByName(plan.select(F.col("destination").alias("path"), F.col("output_hash").alias("sha256")))


def manifest_hash(manifest: DataFrame) -> DataFrame:
    sealed = sealed_digest(manifest, joined("path", "sha256"), F.col("path"))
    return sealed.select(F.col("rows").alias("files"), F.col("digest").alias("inventory_hash"))
