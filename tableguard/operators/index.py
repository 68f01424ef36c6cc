"""The context index: owner-respecting upsert, soft delete, search and checks.

An index is an ordinary table and every write produces its next version, to be saved under a new
path or swapped in by the caller. Identities are unique among active rows, so the joins below
have no hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableguard.functions import fixed as X
from tableguard.operators.catalog import PAGE_ROWS, checked_page
from tableguard.operators.fingerprints import joined as joined_text, sealed_digest, sha256_text
from tableguard.operators.spread import own_if_null

KEY = ["schema_name", "object_name", "object_type"]
OWNED = ["context", "description", "tags", "classification_status", "classification_source"]
TECHNICAL = [
    "source_fingerprint",
    "content_hash",
    "managed_relative_path",
    "header_version",
    "output_format_version",
    "evidence",
]
FIELDS = OWNED + TECHNICAL
# Limits of one entry and of one batch.
MAX_SCHEMA, MAX_NAME, MAX_DESCRIPTION, MAX_LIST, MAX_PATH = 128, 256, 2000, 64, 1024


def _merge(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Active index rows joined with entries: both versions of every field and the outcome."""
    old = index.where("active").select(*KEY, *[F.col(f).alias(f"old_{f}") for f in FIELDS], F.lit(True).alias("was"))
    new = entries.select(*KEY, *[F.col(f).alias(f"new_{f}") for f in FIELDS], F.lit(True).alias("given"))
    both = old.join(new, KEY, "full_outer")
    given, was = F.col("given").isNotNull(), F.col("was").isNotNull()
    kept = given & was & (F.col("old_classification_source") == "owner") & (
        F.col("new_classification_source") != "owner"
    )
    both = both.withColumn("preserved", F.coalesce(kept, F.lit(False)))
    result = {f: F.when(F.col("preserved") | ~given, F.col(f"old_{f}")).otherwise(F.col(f"new_{f}")) for f in OWNED}
    result |= {f: F.when(given, F.col(f"new_{f}")).otherwise(F.col(f"old_{f}")) for f in TECHNICAL}
    both = both.select("*", *[c.alias(f) for f, c in result.items()])
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    action = F.when(~given, F.lit(None)).when(~was, "insert").when(same, "unchanged").otherwise("update")
    return both.withColumn("action", action)


def upsert(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Next version of the index.

    Entries match active rows by schema, name and type. What an owner classified survives a write
    from any other source; technical fields are always taken from the entry.
    """
    active = _merge(index, entries).select(*KEY, *FIELDS, F.lit(True).alias("active"))
    return active.unionByName(index.where("not active").select(*KEY, *FIELDS, "active"))


def upsert_actions(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Action per entry (insert, update, unchanged) and whether owner values were preserved."""
    rows = _merge(index, entries).where(F.col("action").isNotNull())
    return rows.select(*KEY, "action", F.col("preserved").alias("owner_values_preserved"))


def missing_rows(index: DataFrame, present: DataFrame, schemas: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Active rows of a completely read scope that the inventory no longer holds."""
    if not schemas or not types:
        raise ValueError("a complete scope names its schemas and object types")
    scope = F.col("active") & F.col("schema_name").isin(*schemas) & F.col("object_type").isin(*types)
    return index.where(scope).join(present.select(*KEY).distinct(), KEY, "left_anti")


def deactivate_missing(index: DataFrame, present: DataFrame, schemas: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Next version of the index with those rows marked inactive; nothing is deleted."""
    if not schemas or not types:
        raise ValueError("a complete scope names its schemas and object types")
    here = present.select(*KEY).distinct().withColumn("here", F.lit(True))
    scope = F.col("schema_name").isin(*schemas) & F.col("object_type").isin(*types)
    gone = F.col("active") & scope & F.col("here").isNull()
    rows = index.join(here, KEY, "left")
    return rows.select(*[(F.col("active") & ~gone).alias("active") if c == "active" else F.col(c) for c in index.columns])


def search(
    index: DataFrame,
    schemas: Sequence[str],
    *,
    context: str | None = None,
    object_type: str | None = None,
    status: str | None = None,
    tag: str | None = None,
    active: bool = True,
    key: str = "id",
    after=None,
    limit: int = 100,
    most: int | None = PAGE_ROWS,
) -> DataFrame:
    """One page of index rows by key, plus one row when more follow."""
    checked_page(limit, most)
    rows = index.where((F.col("active") == F.lit(active)) & F.col("schema_name").isin(*schemas))
    for column, value in (("context", context), ("object_type", object_type), ("classification_status", status)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    if after is not None:
        rows = rows.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit + 1)


# Checks -------------------------------------------------------------------------------------


def _sorted_unique(c: str) -> Column:
    return F.array_sort(F.array_distinct(c)).eqNullSafe(F.col(c))


def entry_rules() -> dict[str, Column]:
    """Rule name to the condition under which an entry breaks it."""
    control = "[\\x00\\r\\n]"

    def bad_name(c: str, longest: int) -> Column:
        size = F.length(c)
        return F.col(c).isNull() | (size < 1) | (size > longest) | F.col(c).rlike(control)

    def bad_hash(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.col(c).rlike(X.SHA256_RE)

    status, source = F.col("classification_status"), F.col("classification_source")
    unresolved = status == "unresolved"
    guessed = F.col("context").isNotNull() | (F.size("tags") > 0) | (source != "unknown")
    unsure = F.col("context").isNull() | (source == "unknown")
    return {
        "schema_name": bad_name("schema_name", MAX_SCHEMA),
        "object_name": bad_name("object_name", MAX_NAME),
        "object_type": ~F.col("object_type").isin(*X.TYPE_FOLDER),
        "context": F.col("context").isNotNull() & ~F.col("context").rlike(X.SAFE_TERM_RE),
        "description": F.length("description") > MAX_DESCRIPTION,
        "tags": ~_sorted_unique("tags")
        | (F.size("tags") > MAX_LIST)
        | F.exists("tags", lambda t: ~t.rlike(X.SAFE_TERM_RE)),
        "source_fingerprint": bad_hash("source_fingerprint"),
        "content_hash": bad_hash("content_hash"),
        "managed_relative_path": F.length("managed_relative_path") > MAX_PATH,
        "evidence": ~_sorted_unique("evidence")
        | (F.size("evidence") > MAX_LIST)
        | F.exists("evidence", lambda e: (e == "") | e.rlike(control)),
        "classification_status": ~status.isin("confirmed", "unresolved"),
        "classification_source": ~source.isin("owner", "rule", "unknown"),
        "coherent_classification": F.when(unresolved, guessed).otherwise(unsure),
    }


def validate_entries(entries: DataFrame) -> DataFrame:
    """(key columns, rule) for every rule an entry breaks."""
    broken = [F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in entry_rules().items()]
    rows = entries.select(*KEY, F.array_compact(F.array(*broken)).alias("rules"))
    return rows.select(*KEY, F.explode("rules").alias("rule"))


def validate_batch(entries: DataFrame, mode: str = "inventory") -> DataFrame:
    """(rule, identity) for every rule a batch breaks as a whole.

    An unattended inventory batch may neither carry owner classifications nor deactivate rows;
    identities must be unique without regard to case.
    """
    identity = F.concat(
        F.col("object_type"), F.lit(":"), F.lower("schema_name"), F.lit("."), F.lower("object_name")
    )
    rows = entries.withColumn("identity", identity)
    twice = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = twice.select(F.lit("duplicate_identity").alias("rule"), "identity")
    if mode == "inventory":
        broken = F.array_compact(
            F.array(
                F.when(F.col("classification_source") == "owner", F.lit("owner_requires_owner_mode")),
                F.when(~F.col("active"), F.lit("deactivation_requires_owner_mode")),
            )
        )
        out = out.unionByName(rows.select(F.explode(broken).alias("rule"), "identity"))
    return out


def scope_filter(entries: DataFrame, schemas: Sequence[str], types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): entries inside the allowed schemas and types, and why others are not."""
    reason = F.when(~F.col("schema_name").isin(*schemas), "SCHEMA_NOT_ALLOWED").when(
        ~F.col("object_type").isin(*types), "OBJECT_TYPE_NOT_ALLOWED"
    )
    rows = entries.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select(*KEY, "reason")


def sync_result(actions: DataFrame, deactivated: DataFrame | None = None) -> DataFrame:
    """One row of totals over the actions of a sync."""
    n = actions.agg(
        F.count_if(F.col("action") == "insert").alias("inserted"),
        F.count_if(F.col("action") == "update").alias("updated"),
        F.count_if("owner_values_preserved").alias("owner_values_preserved"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
    )
    if deactivated is None:
        return n.withColumn("deactivated", F.lit(0).cast("long"))
    gone = deactivated.agg(F.count(F.lit(1)).alias("deactivated"))
    one = F.lit(1).alias("k")
    return n.select(one, "*").join(gone.select(one, "*"), "k").drop("k")


# Generation ---------------------------------------------------------------------------------


def generation_plan(index: DataFrame, corpus: DataFrame, include_unresolved: bool = False) -> DataFrame:
    """Index rows checked against their managed files: one row each with its drift, if any.

    ``corpus`` is the output of ``corpus.parse_header`` (``path, state, header, body``). Rows
    without a path meet no file; each has a join key of its own.
    """
    rows = index.where("active")
    if not include_unresolved:
        rows = rows.where(F.col("classification_status") != "unresolved")
    files = corpus.select(
        F.col("path").alias("__tg_path"), "state", "header", sha256_text("body").alias("body_hash")
    ).withColumn("found", F.lit(True))
    keyed = rows.withColumn("__tg_path", own_if_null(F.col("managed_relative_path"), *KEY))
    joined = keyed.join(files, "__tg_path", "left")
    oid = F.concat(F.col("object_type"), F.lit(":"), F.col("schema_name"), F.lit("."), F.col("object_name"))
    same = oid.eqNullSafe(F.col("header.object_id")) & F.col("object_type").eqNullSafe(F.col("header.object_type"))
    for f in OWNED + ["source_fingerprint", "evidence", "header_version", "output_format_version", "content_hash"]:
        same = same & F.col(f).eqNullSafe(F.col(f"header.{f}"))
    drift = (
        F.when(F.col("managed_relative_path").isNull() | F.col("content_hash").isNull(), "path_or_hash_missing")
        .when(F.col("found").isNull(), "file_missing")
        .when(F.col("state") != "ok", "header_invalid")
        .when(~same, "header_differs")
        .when(F.col("body_hash") != F.col("content_hash"), "body_differs")
    )
    return joined.select(oid.alias("object_id"), *KEY, *FIELDS, drift.alias("drift"))


def plan_hash(items: DataFrame) -> DataFrame:
    """One hash over the items of a plan, whatever their order."""
    payload = joined_text("object_id", "managed_relative_path", "content_hash")
    return sealed_digest(items, payload, F.col("object_id").cast("string")).select(F.col("rows").alias("items"), F.col("digest").alias("plan_hash"))
