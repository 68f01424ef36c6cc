"""Catalog tables: discovery, diffs, samples, plans, retention and accounting.

Objects are rows ``(object_id, schema_name, object_name, object_type, ...)``. Patterns, scopes
and selections are small requests held by the driver and become predicates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableguard.functions import fixed as X
from tableguard.functions.values import as_col, java
from tableguard.operators.protect import protect

# Status names and reason codes written into results.
REUSABLE = ("ready", "completed", "completed_with_warnings")
BUSY = ("running", "queued")
LOOKUP = "lut"
# Spellings of object types.
TYPE_NAMES = {
    "table": ("table", "base table", "u"),
    "procedure": ("procedure", "stored procedure", "p"),
    "function": ("function", "fn", "if", "tf"),
}


def glob_regex(pattern: str) -> str:
    """Shell pattern (``* ? [..]``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body.replace("^", r"\^")) + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}\\z"


def _matches_any(name: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | name.rlike(glob_regex(p))
    return hit


def object_type(raw: Column | str) -> Column:
    """Normal object type; null for a type that is not supported."""
    r = F.lower(as_col(raw))
    out = None
    for kind, names in TYPE_NAMES.items():
        out = F.when(r.isin(*names), kind) if out is None else out.when(r.isin(*names), kind)
    return out


def object_id(kind: str = "object_type", schema: str = "schema_name", name: str = "object_name") -> Column:
    return F.concat(F.col(kind), F.lit(":"), F.col(schema), F.lit("."), F.col(name))


def visible_schemas(schemas: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Every visible schema and whether the profile allows it."""
    return schemas.select("schema_name", F.col("schema_name").isin(*allowed).alias("allowed")).distinct()


def discover(
    raw: DataFrame, allowed_schemas: Sequence[str], types: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Objects inside the allowed scope. ``raw`` has ``schema_name, object_name, raw_type``."""
    kind = object_type("raw_type")
    kept = raw.where(F.col("schema_name").isin(*allowed_schemas)).withColumn("object_type", kind)
    kept = kept.where(F.col("object_type").isin(*types))
    if exclude:
        kept = kept.where(~_matches_any(F.lower("object_name"), [p.lower() for p in exclude]))
    return kept.withColumn("object_id", object_id()).drop("raw_type")


def request_filter(
    objects: DataFrame,
    schemas: Sequence[str],
    types: Sequence[str],
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(kept, unmatched): objects a request asks for, and include patterns that matched none.

    Exclude patterns are case-sensitive, include patterns are not. An unmatched pattern is
    flagged when it would have matched an excluded object.
    """
    scoped = objects.where(F.col("schema_name").isin(*schemas) & F.col("object_type").isin(*types))
    name, low = F.col("object_name"), F.lower("object_name")
    excluded = _matches_any(name, exclude)
    wanted = _matches_any(low, [p.lower() for p in include]) if include else F.lit(True)
    kept = scoped.where(~excluded & wanted)
    patterns = sorted(set(include))
    if not patterns:
        none = objects.sparkSession.createDataFrame([], "pattern string, excluded_by_policy boolean")
        return kept, none
    hits = []
    for i, p in enumerate(patterns):
        hit = low.rlike(glob_regex(p.lower()))
        hits.append(F.coalesce(F.bool_or(hit & ~excluded), F.lit(False)).alias(f"kept_{i}"))
        hits.append(F.coalesce(F.bool_or(hit), F.lit(False)).alias(f"seen_{i}"))
    rows = [
        F.struct(
            F.lit(p).alias("pattern"),
            F.col(f"seen_{i}").alias("excluded_by_policy"),
            F.col(f"kept_{i}").alias("matched"),
        )
        for i, p in enumerate(patterns)
    ]
    unmatched = scoped.agg(*hits).select(F.inline(F.array(*rows))).where("not matched").drop("matched")
    return kept, unmatched


# Incremental comparison -------------------------------------------------------------------


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(object_id, change): added, deleted, changed or unchanged by ``fingerprint``."""
    b = before.select("object_id", F.col("fingerprint").alias("old"), F.lit(True).alias("in_old"))
    a = after.select("object_id", F.col("fingerprint").alias("new"), F.lit(True).alias("in_new"))
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "deleted")
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .otherwise("changed")
    )
    return b.join(a, "object_id", "full_outer").select("object_id", change.alias("change"), "old", "new")


def diff_summary(changes: DataFrame) -> DataFrame:
    """Counts of a diff. Changes are only counted when both sides carry fingerprints."""
    complete = F.coalesce(F.bool_or(F.col("old").isNotNull()), F.lit(False)) & F.coalesce(
        F.bool_or(F.col("new").isNotNull()), F.lit(False)
    )
    n = {c: F.count_if(F.col("change") == c) for c in ("added", "changed", "deleted", "unchanged")}
    return changes.agg(
        n["added"].alias("added"),
        F.when(complete, n["changed"]).otherwise(F.lit(0)).cast("long").alias("changed"),
        n["deleted"].alias("deleted"),
        F.when(complete, n["unchanged"]).otherwise(F.lit(0)).cast("long").alias("reused"),
        complete.alias("complete"),
    )


def carry_forward(before: DataFrame, after: DataFrame) -> DataFrame:
    """New objects with the stored definition of every object whose fingerprint did not change.

    A reused table gets its definition back but neither sample nor dependencies, which follow
    the data and are read again.
    """
    stored = before.where(F.col("definition").isNotNull()).select(
        "object_id",
        F.col("fingerprint").alias("old_fingerprint"),
        F.col("definition").alias("old_definition"),
        F.col("sample").alias("old_sample"),
        F.col("dependencies").alias("old_dependencies"),
    )
    joined = after.join(stored, "object_id", "left")
    reused = F.coalesce(F.col("fingerprint") == F.col("old_fingerprint"), F.lit(False))
    routine = reused & (F.col("object_type") != "table")
    return joined.select(
        *[F.col(c) for c in after.columns],
        F.when(reused, F.col("old_definition")).alias("definition"),
        F.when(routine, F.col("old_sample")).alias("sample"),
        F.when(routine, F.col("old_dependencies")).alias("dependencies"),
        reused.alias("reused"),
    )


def sync_totals(contexts: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row over refreshed contexts and skip reasons (``reason, n``)."""
    ok = F.col("status") == "synced"
    counted = ["added", "changed", "deleted", "reused", "refreshed"]
    done = contexts.agg(
        F.count(F.lit(1)).alias("contexts"),
        F.count_if(ok).alias("synced"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in counted],
        F.coalesce(F.bool_and(F.when(ok, F.col("complete"))), F.lit(False)).alias("all_complete"),
    )
    left = skipped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("skipped"))
    both = done.select(F.lit(1).alias("k"), "*").join(left.select(F.lit(1).alias("k"), "*"), "k")
    return both.select(
        (F.col("contexts") + F.col("skipped")).alias("considered"),
        "synced",
        "skipped",
        "failed",
        *counted,
        (F.col("all_complete") & (F.col("failed") == 0)).alias("complete"),
    )


# Keys, indexes and foreign keys ------------------------------------------------------------


def _ordered(column: str, order: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(order, column))))
    return F.transform(pairs, lambda p: p[column])


def group_constraints(rows: DataFrame) -> DataFrame:
    """Constraint rows to one row per constraint with its ordered columns.

    The lists are bounded by the key columns a database allows in one constraint.
    """
    kind = F.lower("constraint_type")
    kind = (
        F.when(kind.isin("primary key", "p"), "primary_key")
        .when(kind.isin("unique", "u"), "unique")
        .when(kind.isin("foreign key", "r"), "foreign_key")
        .otherwise("check")
    )
    return (
        rows.withColumn("constraint_type", kind)
        .groupBy("object_id", "constraint_name", "constraint_type")
        .agg(_ordered("column_name", "ordinal").alias("columns"), F.max("expression").alias("expression"))
    )


def group_indexes(rows: DataFrame) -> DataFrame:
    """Index rows to one row per index: ordered key columns and included columns."""
    kept = rows.where(F.coalesce(F.col("index_name"), F.lit("")) != "")
    inc = F.coalesce(F.col("is_included"), F.lit(False))
    split = kept.select(
        "*",
        F.when(~inc, F.col("column_name")).alias("key_column"),
        F.when(inc, F.col("column_name")).alias("included_column"),
    )
    return split.groupBy("object_id", "index_name").agg(
        F.bool_or("is_unique").alias("is_unique"),
        F.bool_or("is_primary").alias("is_primary"),
        _ordered("key_column", "column_order").alias("key_columns"),
        _ordered("included_column", "column_order").alias("included_columns"),
    )


def group_foreign_keys(rows: DataFrame) -> DataFrame:
    """Foreign-key rows to one row per key, columns paired by position."""
    target = F.concat(F.lit("table:"), F.col("target_schema"), F.lit("."), F.col("target_table"))
    return (
        rows.withColumn("target_object_id", target)
        .groupBy("source_object_id", "constraint_name", "target_object_id")
        .agg(
            _ordered("source_column", "ordinal").alias("source_columns"),
            _ordered("target_column", "ordinal").alias("target_columns"),
        )
        .withColumnRenamed("constraint_name", "name")
    )


# Samples ------------------------------------------------------------------------------------


def sampling_order(
    columns: Sequence[str], primary: Sequence[str] | None = None, unique: Sequence[str] | None = None
) -> tuple[list[str], bool]:
    """(order columns, deterministic): primary key, else a unique key, else the first column."""
    keys = list(primary or unique or [])
    return (keys, True) if keys else (list(columns[:1]), False)


#: Usual rows of a sample and of a page; both are parameters, and None lifts them.
SAMPLE_ROWS, PAGE_ROWS = (10, 20), 250


def _checked_size(n: int, bounds: tuple[int, int] | None) -> int:
    if bounds is not None and not bounds[0] <= n <= bounds[1]:
        raise ValueError(f"a sample holds {bounds[0]} to {bounds[1]} rows")
    return n


def checked_page(limit: int, most: int | None) -> int:
    if limit < 1 or most is not None and limit > most:
        raise ValueError(f"a page holds 1 to {most} rows")
    return limit


def sample(
    table: DataFrame,
    n: int,
    primary: Sequence[str] | None = None,
    unique: Sequence[str] | None = None,
    bounds: tuple[int, int] | None = SAMPLE_ROWS,
) -> DataFrame:
    """First ``n`` rows by key: a top-k per task, then one merge of at most n rows per task."""
    order, _ = sampling_order(table.columns, primary, unique)
    return table.orderBy(*order).limit(_checked_size(n, bounds))


def sample_groups(
    table: DataFrame, group: Sequence[str], order: Sequence[str], n: int, bounds: tuple[int, int] | None = SAMPLE_ROWS
) -> DataFrame:
    """``n`` rows per group of stacked tables.

    The rank filter runs on the map side first, so a hot group sends n rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return table.withColumn("sample_rank", rank).where(F.col("sample_rank") <= _checked_size(n, bounds))


def sample_status(page: DataFrame, requested: int, deterministic: bool, by: Sequence[str] = ()) -> DataFrame:
    """Rows asked for and given, of the whole sample or of each of its groups."""
    n = F.count(F.lit(1))
    return page.groupBy(*by).agg(
        F.lit(requested).cast("long").alias("requested_count"),
        n.alias("actual_count"),
        F.when(n < requested, "source_returned_fewer_rows").alias("shortage_reason"),
        F.lit(deterministic).alias("deterministic"),
    )


def lookup_snapshot(
    plan_rows: DataFrame, read: Callable[[str], DataFrame], policy: Mapping[str, Mapping[str, str]], key
) -> dict[str, DataFrame]:
    """Whole protected table for every lookup table of a plan.

    Only object names travel to the driver (a plan is metadata); the tables stay distributed.
    """
    chosen = plan_rows.where((F.col("final_category") == LOOKUP) & (F.col("object_type") == "table"))
    ids = [r["object_id"] for r in chosen.select("object_id").distinct().toLocalIterator()]
    return {i: protect(read(i), policy.get(i), key) for i in ids}


def lookup_layouts(plan_rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(layout, object_ids) of the lookup tables of a plan: those with equal columns and types together.

    ``columns`` has ``object_id, ordinal, column_name, data_type``.
    """
    chosen = plan_rows.where((F.col("final_category") == LOOKUP) & (F.col("object_type") == "table")).select("object_id").distinct()
    listed = F.array_sort(F.collect_set(F.struct("ordinal", "column_name", "data_type")))
    shapes = columns.join(chosen, "object_id", "left_semi").groupBy("object_id").agg(F.sha2(F.to_json(listed), 256).alias("layout"))
    return shapes.groupBy("layout").agg(F.array_sort(F.collect_set("object_id")).alias("object_ids"))


def lookup_rows(
    plan_rows: DataFrame, columns: DataFrame, read: Callable[[Sequence[str]], DataFrame], policy: Mapping[str, str], key
) -> DataFrame:
    """(object_id, row) of all rows of all lookup tables of a plan, protected, as JSON.

    ``read`` takes the ids of tables with equal columns and returns their rows under one another,
    with ``object_id``: one scan for many tables. ``policy`` gives the class of a column name in any
    of them. The plan has one branch for each different layout, not for each table. Null columns are
    left out of the JSON; a plan without lookup tables gives no rows.
    """
    out = None
    for layout in lookup_layouts(plan_rows, columns).orderBy("layout").toLocalIterator():
        table = read(layout["object_ids"])
        body = [c for c in table.columns if c != "object_id"]
        shown = protect(table, {c: k for c, k in policy.items() if c in body}, key, settled={"object_id": (X.PUBLIC, "object_id")})
        rows = shown.select("object_id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in body])).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return plan_rows.sparkSession.createDataFrame([], "object_id string, row string") if out is None else out


# Categories and plans -----------------------------------------------------------------------


def preliminary_category(name: Column | str) -> Column:
    """First part of a name with two or more ``_`` parts, when it is an identifier."""
    parts = F.filter(F.split(F.lower(as_col(name)), "_"), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    ok = (F.size(parts) >= 2) & first.rlike(java(r"^[\p{L}\p{Nl}][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}]*$"))
    return F.when(ok, first)


def category_preview(objects: DataFrame, names: int = 10) -> DataFrame:
    """Objects per preliminary category with their smallest names; null is the unresolved rest."""
    tagged = objects.select(preliminary_category("object_name").alias("category"), "object_name")
    counts = tagged.groupBy("category").agg(F.count(F.lit(1)).alias("object_count"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("object_name"))
    first = (
        tagged.where(F.col("category").isNotNull())
        .withColumn("r", rank)
        .where(F.col("r") <= names)
        .groupBy("category")
        .agg(F.array_sort(F.collect_list("object_name")).alias("representative_names"))
    )
    return counts.join(first, "category", "left")


def plan(
    objects: DataFrame,
    final: DataFrame,
    mode: str = "ask",
    selected: Sequence[str] = (),
    confirmed_only: bool = False,
) -> DataFrame:
    """Which objects are materialised, with the category and the reason.

    ``final`` has ``object_id, category, status`` of the second pass. Without ``confirmed_only``
    an object that was never classified falls back to its preliminary category.
    """
    if mode not in ("ask", "all", "selected"):
        raise ValueError(f"unknown mode {mode}")
    f = final.select(
        "object_id", F.col("category").alias("f_category"), F.col("status").alias("f_status")
    ).withColumn("f_known", F.lit(True))
    joined = objects.join(f, "object_id", "left")
    if confirmed_only:
        category = F.when(F.col("f_status") == "final_confirmed", F.col("f_category"))
    else:
        category = F.when(F.col("f_known"), F.col("f_category")).otherwise(preliminary_category("object_name"))
    c = F.col("final_category")
    lookup = (c == LOOKUP) if mode != "ask" else F.lit(False)
    chosen = c.isin(*selected) if mode == "selected" and selected else F.lit(False)
    included = F.lit(True) if mode == "all" else F.coalesce(lookup | chosen, F.lit(False))
    if mode == "all":
        reason = F.lit("all_mode")
    else:
        reason = (
            F.when(F.col("included") & (c == LOOKUP), "policy_always_include")
            .when(F.col("included"), "selected_category")
            .otherwise("intentionally_excluded")
        )
    return (
        joined.withColumn("final_category", category)
        .withColumn("included", included)
        .withColumn("reason", reason)
        .select("object_id", "object_type", "final_category", "included", "reason")
    )


def sitemap(objects: DataFrame, final: DataFrame, plan_rows: DataFrame | None = None) -> DataFrame:
    """Object, category (final, else preliminary), reason and content hash."""
    f = final.select("object_id", F.col("category").alias("f_category")).withColumn("f_known", F.lit(True))
    rows = objects.join(f, "object_id", "left")
    category = F.when(F.col("f_known"), F.col("f_category")).otherwise(preliminary_category("object_name"))
    if plan_rows is None:
        rows = rows.withColumn("reason", F.lit("all_mode"))
    else:
        rows = rows.join(plan_rows.select("object_id", "reason"), "object_id", "left")
        rows = rows.withColumn("reason", F.coalesce("reason", F.lit("all_mode")))
    return rows.select(
        "object_id",
        category.alias("category"),
        "object_type",
        F.col("reason").alias("inclusion_reason"),
        F.col("source_fingerprint").alias("content_hash"),
    )


def page(df: DataFrame, key: str, after=None, limit: int = 100, most: int | None = PAGE_ROWS) -> DataFrame:
    """One bounded page after a key, plus one row when more follow (``has_more`` by count)."""
    checked_page(limit, most)
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit + 1)


# Records ------------------------------------------------------------------------------------


def latest_eligible(
    records: DataFrame, key_cols: Sequence[str], now: Column, created: str = "created_at", tie: str = "record_id"
) -> tuple[DataFrame, DataFrame]:
    """(rows, skip_counts): newest eligible record per key, and why the others were skipped.

    ``records`` has a session key first in ``key_cols``, ``expires_at, status, selection_mode``
    and optionally ``corrupt``. The newest record per key is an aggregate over the key, the time
    and the tie alone, not a window, so a key that holds much of the table is reduced before the
    shuffle; whole rows are met by all three, which spreads a hot key's records. Records that agree
    in all three all stay.
    """
    session = F.col(key_cols[0])
    corrupt = F.col("corrupt") if "corrupt" in records.columns else F.lit(False)
    reason = (
        F.when(corrupt, "runtime_state_corrupt")
        .when(session.isNull() | (session.cast("string") == ""), "session_cache_key_missing")
        .when(F.col("expires_at") <= now, "expired")
        .when(~F.col("status").isin(*REUSABLE), F.concat(F.lit("status_"), F.col("status")))
        .when(F.col("selection_mode").isNull() | (F.col("selection_mode") == "ask"), "selection_incomplete")
    )
    tagged = records.withColumn("__tg_reason", reason)
    eligible = tagged.where(F.col("__tg_reason").isNull()).drop("__tg_reason")
    keys = [F.col(k).alias(f"__tg_k{i}") for i, k in enumerate(key_cols)]
    kept = eligible.groupBy(*keys).agg(F.max(F.struct(F.col(created).alias("at"), F.col(tie).alias("tie"))).alias("__tg_top"), F.count(F.lit(1)).alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"__tg_k{i}")) for i, k in enumerate(key_cols)]
    same += [F.col(created).eqNullSafe(F.col("__tg_top.at")), F.col(tie).eqNullSafe(F.col("__tg_top.tie"))]
    rows = eligible.join(kept, reduce(and_, same), "left_semi")
    skipped = (
        tagged.where(F.col("__tg_reason").isNotNull())
        .groupBy(F.col("__tg_reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .unionByName(
            kept.agg(F.sum(F.col("n") - 1).alias("n")).select(F.lit("superseded").alias("reason"), "n")
        )
        .where("n > 0")
    )
    return rows, skipped


def retention(records: DataFrame, pins: DataFrame, now: Column) -> DataFrame:
    """Records that may be removed: expired, not running and not pinned by an active dependant."""
    pinned = pins.where(F.col("active") | (F.col("expires_at") > now)).select("record_id").distinct()
    old = records.where((F.col("expires_at") <= now) & ~F.col("status").isin(*BUSY))
    return old.join(pinned, "record_id", "left_anti")


# Accounting ---------------------------------------------------------------------------------


def status(objects: DataFrame, failures: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """One row of counts. ``failures`` has ``object_id, stage, error_code``; a failed analysis
    removes the object, failed samples and dependencies only raise a warning."""
    one = F.lit(1).alias("k")
    found = objects.agg(F.count(F.lit(1)).alias("analysed")).select(one, "*")
    failed = failures.agg(
        F.count_if(F.col("stage") == "analysis").alias("failed"),
        F.count_if(F.col("stage") == "sample").alias("failed_samples"),
        F.count_if(F.col("stage") == "dependencies").alias("failed_dependencies"),
    ).select(one, "*")
    planned = plan_rows.agg(
        F.count_if("included").alias("materialised"), F.count_if(~F.col("included")).alias("excluded")
    ).select(one, "*")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("failed_samples") > 0, "sample_extraction_incomplete"),
            F.when(F.col("failed_dependencies") > 0, "dependency_extraction_incomplete"),
        )
    )
    return (
        found.join(failed, "k")
        .join(planned, "k")
        .select(
            (F.col("analysed") + F.col("failed")).alias("discovered"),
            "analysed",
            "failed",
            "materialised",
            "excluded",
            F.array_join(warnings, ",").alias("warnings"),
        )
    )


def prove_complete(expected: DataFrame, submitted: DataFrame, counts: DataFrame, request: Mapping) -> DataFrame:
    """One row: whether a catalog exactly covers its profile, and the sizes of both differences.

    ``expected`` and ``submitted`` hold ``object_id``; ``counts`` is the result of
    :func:`status`; ``request`` states the scope flags known to the driver.
    """
    scope_ok = bool(
        request.get("mode") == "all"
        and not request.get("include")
        and not request.get("exclude")
        and not request.get("profile_exclude")
        and set(request.get("schemas", ())) == set(request.get("allowed_schemas", ()))
        and set(request.get("types", ())) == set(request.get("allowed_types", ()))
    )
    e = expected.select(F.lower("object_id").alias("id")).distinct()
    s = submitted.select(F.lower("object_id").alias("id")).distinct()
    sides = e.withColumn("e", F.lit(1)).join(s.withColumn("s", F.lit(1)), "id", "full_outer")
    gap = sides.agg(
        F.lit(1).alias("k"),
        F.count_if(F.col("s").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("unexpected"),
        F.count("e").alias("expected"),
    )
    c = counts.select(F.lit(1).alias("k"), "discovered", "analysed", "failed")
    ok = (
        F.lit(scope_ok)
        & (F.col("missing") == 0)
        & (F.col("unexpected") == 0)
        & (F.col("failed") == 0)
        & (F.col("discovered") == F.col("expected"))
        & (F.col("analysed") == F.col("expected"))
    )
    return gap.join(c, "k").select("expected", "missing", "unexpected", "failed", ok.alias("complete"))


def sql_signature(c: Column | str) -> Column:
    """Expression text without brackets, parentheses, spaces and case."""
    return F.upper(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"[\[\]()\s]", ""))


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Differences between two metadata tables ``(kind, name, definition)``.

    Kinds are column, default, check, index and object. Definitions are compared by signature.
    """
    e = expected.select("kind", "name", sql_signature("definition").alias("expected")).withColumn("in_e", F.lit(1))
    a = actual.select("kind", "name", sql_signature("definition").alias("actual")).withColumn("in_a", F.lit(1))
    state = (
        F.when(F.col("in_a").isNull(), "missing")
        .when(F.col("in_e").isNull(), F.when(F.col("kind") == "object", "unexpected").otherwise("extra"))
        .when(F.col("expected") != F.col("actual"), "mismatch")
    )
    rows = e.join(a, ["kind", "name"], "full_outer").withColumn("state", state)
    return rows.where(F.col("state").isNotNull()).select("kind", "name", "state", "expected", "actual")
