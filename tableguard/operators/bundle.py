"""Materialised output: paths, inventories, assembly of batches and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableguard.functions import fixed as X
from tableguard.functions.values import as_col
from tableguard.operators.fingerprints import joined, sealed_digest, sha256_text

# Reports rebuilt during assembly, by output profile.
REPORTS = {
    "full": ("manifest.yaml", "reports/export-summary.md", "reports/integrity-report.json"),
    "ai": ("manifest.yaml", "context-index.md", "reports/export-summary.md", "reports/integrity-report.md"),
}


def safe_segment(c: Column | str) -> Column:
    """Path segment of safe characters; null when nothing safe is left."""
    text = F.trim(F.regexp_replace(as_col(c), r"[^A-Za-z0-9_.-]+", "_"), F.lit("."))
    return F.nullif(text, F.lit(""))


def output_paths(objects: DataFrame) -> DataFrame:
    """Path of every materialised object (``object_id, schema_name, object_name, object_type,
    category``).

    Of objects that map to one path, the smallest id keeps it and the others get their schema and
    a hash in the name. The owner of a path is an aggregate joined back, so many equal names do
    not meet in one task.
    """
    folder = F.when(F.col("object_type") == "table", "tables").when(
        F.col("object_type") == "function", "functions"
    ).otherwise("store_procedures")
    base = F.concat(
        safe_segment(F.coalesce(F.col("category"), F.lit("unknowns"))), F.lit("/"), folder, F.lit("/")
    )
    name = safe_segment("object_name")
    rows = objects.withColumn("__tg_base", base).withColumn("__tg_path", F.concat("__tg_base", name, F.lit(".sql")))
    owners = rows.groupBy("__tg_path").agg(F.min("object_id").alias("__tg_owner"))
    rows = rows.join(owners, "__tg_path", "left")
    suffix = F.substring(F.sha2("object_id", 256), 1, 10)
    longer = F.concat(
        F.col("__tg_base"), safe_segment("schema_name"), F.lit("__"), name, F.lit("__"), suffix, F.lit(".sql")
    )
    path = F.when(F.col("object_id") == F.col("__tg_owner"), F.col("__tg_path")).otherwise(longer)
    return rows.select(*objects.columns, path.alias("path"))


def path_problems(paths: DataFrame) -> DataFrame:
    """Objects without a safe path, and paths claimed more than once."""
    unsafe = paths.where("path is null").select("object_id", F.lit("UNSAFE_OUTPUT_PATH").alias("problem"))
    twice = paths.where("path is not null").groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.min("object_id").alias("object_id")
    )
    return unsafe.unionByName(
        twice.where("n > 1").select("object_id", F.lit("DUPLICATE_OUTPUT_PATH").alias("problem"))
    )


def inventory(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256) of files with ``path, content``."""
    return files.select(
        "path", F.octet_length("content").cast("long").alias("size_bytes"), sha256_text("content").alias("sha256")
    )


def inventory_hash(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number, bytes and one hash of the files of an inventory, whatever their order."""
    sealed = sealed_digest(items, joined("path", "size_bytes", "sha256"), F.col("path"), list(by), sums={"bytes": F.col("size_bytes")})
    return sealed.select(*by, F.col("rows").alias("files"), "bytes", F.col("digest").alias("inventory_sha256"))


def distinct_bundles(files: DataFrame) -> DataFrame:
    """One batch of every set of batches with identical content."""
    prints = inventory_hash(files, ["batch"])
    return prints.groupBy("inventory_sha256").agg(F.min("batch").alias("batch")).select("batch")


def assemble(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, conflicts) of batches ``batch, path, size_bytes, sha256, output_profile``.

    Identical batches count once. A path must have one content in all batches, and all batches
    one output profile. Reports are rebuilt afterwards and are left out here.
    """
    rebuilt = sorted({p for paths in REPORTS.values() for p in paths})
    kept = files.join(distinct_bundles(files), "batch", "left_semi")
    content = F.struct("size_bytes", "sha256")
    paths = (
        kept.where(~F.col("path").isin(*rebuilt))
        .groupBy("path")
        .agg(F.min(content).alias("low"), F.max(content).alias("high"))
    )
    same = F.col("low") == F.col("high")
    merged = paths.where(same).select("path", "low.size_bytes", "low.sha256")
    conflicts = paths.where(~same).select(F.lit("EXPORT_BATCH_CONFLICT").alias("problem"), "path")
    profiles = kept.agg(F.min("output_profile").alias("a"), F.max("output_profile").alias("b"))
    mixed = profiles.where("a != b").select(
        F.lit("EXPORT_PROFILE_CONFLICT").alias("problem"), F.lit(None).cast("string").alias("path")
    )
    return merged, conflicts.unionByName(mixed)


def merge_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, conflicts) of per-object results ``object_id, status, detail`` of all batches."""
    row = F.struct("status", "detail")
    merged = results.groupBy("object_id").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    same = F.col("low") == F.col("high")
    return (
        merged.where(same).select("object_id", "low.status", "low.detail"),
        merged.where(~same).select("object_id"),
    )


def result_counts(results: DataFrame) -> DataFrame:
    """Status counts of merged results and whether they add up."""
    state = F.col("status")
    counted = results.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(state == "formatted").alias("formatted"),
        F.count_if(state == "parse_failed").alias("parse_failed_preserved"),
        F.count_if(state.isin("format_failed", "rolled_back")).alias("format_failed_preserved"),
    )
    total = F.col("formatted") + F.col("parse_failed_preserved") + F.col("format_failed_preserved")
    return counted.withColumn("accounted", F.col("requested") == total)


def stale(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Managed paths of the last run that the new output no longer holds."""
    return previous.select("path").distinct().join(incoming.select("path"), "path", "left_anti")


def unmanaged_conflicts(existing: DataFrame, previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming paths that would overwrite a different file nobody manages."""
    foreign = existing.join(previous.select("path").distinct(), "path", "left_anti")
    new = incoming.select("path", F.col("sha256").alias("new_sha256"))
    return foreign.join(new, "path").where(F.col("sha256") != F.col("new_sha256")).select("path")


def reread_check(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against re-read files: missing, mismatch or undeclared."""
    d = manifest.select("path", F.col("size_bytes").alias("d_size"), F.col("sha256").alias("d_sha"))
    a = actual.select("path", F.col("size_bytes").alias("a_size"), F.col("sha256").alias("a_sha"))
    state = (
        F.when(F.col("a_sha").isNull(), "missing")
        .when(F.col("d_sha").isNull(), "undeclared")
        .when((F.col("d_size") != F.col("a_size")) | (F.col("d_sha") != F.col("a_sha")), "mismatch")
    )
    rows = d.join(a, "path", "full_outer").withColumn("state", state)
    return rows.where("state is not null").select("path", "state")


def reconcile(
    manifests: DataFrame, submitted: DataFrame, status: DataFrame, expected: Mapping, profile: str = "full"
) -> DataFrame:
    """One row of checks and the list of errors.

    ``manifests`` are the declared files of all exports with ``output_format_version`` and
    ``output_profile``; ``submitted`` is the assembled inventory; ``status`` comes from
    ``catalog.status``; ``expected`` holds the counts the caller believes in.
    """
    rebuilt = sorted({p for paths in REPORTS.values() for p in paths})
    reports = [p for p in REPORTS[profile] if p != "manifest.yaml"]
    one = F.lit(1).alias("k")
    heads = manifests.agg(
        F.coalesce(F.bool_and(F.col("output_format_version") == expected["version"]), F.lit(False)).alias("version_ok"),
        F.coalesce(F.bool_and(F.col("output_profile") == profile), F.lit(False)).alias("profile_ok"),
    )
    content = F.struct("size_bytes", "sha256")
    declared = (
        manifests.where(~F.col("path").isin(*rebuilt))
        .groupBy("path")
        .agg(F.min(content).alias("low"), F.max(content).alias("high"))
    )
    given = submitted.select("path", content.alias("given"))
    sides = declared.join(given, "path", "full_outer")
    is_report = F.col("path").isin(*reports)
    checks = sides.agg(
        F.count_if(F.col("low") != F.col("high")).alias("conflicting_paths"),
        F.count_if(F.col("low").isNotNull() & ~F.col("given").eqNullSafe(F.col("high"))).alias("wrong_or_missing"),
        F.count_if(F.col("low").isNull() & ~is_report & (F.col("path") != "manifest.yaml")).alias("undeclared"),
        F.count_if(is_report & F.col("given").isNotNull()).alias("reports"),
        F.count_if(F.col("given").isNotNull() & (F.col("path") == "manifest.yaml")).alias("manifest_rows"),
    )
    row = heads.select(one, "*").join(checks.select(one, "*"), "k").join(status.select(one, "*"), "k")
    complete = (
        (F.col("wrong_or_missing") == 0)
        & (F.col("undeclared") == 0)
        & (F.col("reports") == len(reports))
        & (F.col("manifest_rows") == 1)
    )
    tests = {
        "conflicting_managed_path": F.col("conflicting_paths") == 0,
        "output_profile_mismatch": F.col("profile_ok"),
        "assembled_inventory_mismatch": complete,
        "output_format_version_mismatch": F.col("version_ok"),
        "discovered_count_mismatch": F.col("discovered") == expected["discovered"],
        "analyzed_count_mismatch": F.col("analysed") == expected["analysed"],
        "materialized_count_mismatch": F.col("materialised") == expected["materialised"],
        "exclusion_count_mismatch": F.col("analysed") == F.col("materialised") + F.col("excluded"),
    }
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(code)) for code, ok in tests.items()]))
    return row.select(
        (F.size(errors) == 0).alias("valid"),
        tests["discovered_count_mismatch"].alias("discovered_count_valid"),
        tests["analyzed_count_mismatch"].alias("analyzed_count_valid"),
        tests["materialized_count_mismatch"].alias("materialized_count_valid"),
        tests["exclusion_count_mismatch"].alias("exclusion_count_valid"),
        F.col("version_ok").alias("output_format_version_valid"),
        complete.alias("assembled_inventory_complete"),
        F.array_join(errors, ",").alias("errors"),
    )


# Reports ------------------------------------------------------------------------------------


def masking_report(redacted: DataFrame, skipped: DataFrame) -> DataFrame:
    """Totals of a redaction run (``secrets, marks`` per object) and of the objects it refused."""
    one = F.lit(1).alias("k")
    done = redacted.agg(
        F.coalesce(F.sum("secrets"), F.lit(0)).alias("secret_literals_redacted"),
        F.coalesce(F.sum("marks"), F.lit(0)).alias("pii_literals_redacted"),
    )
    left = skipped.agg(F.count(F.lit(1)).alias("objects_skipped_security"))
    return done.select(one, "*").join(left.select(one, "*"), "k").drop("k")


def classification_report(final: DataFrame, changes: DataFrame) -> DataFrame:
    """Objects per status and category, with moves into and out of the selection."""
    c = changes.select("object_id", "moved_into_selected", "moved_out_of_selected")
    return (
        final.join(c, "object_id", "left")
        .groupBy("status", "category")
        .agg(
            F.count(F.lit(1)).alias("objects"),
            F.count_if("moved_into_selected").alias("moved_into_selected"),
            F.count_if("moved_out_of_selected").alias("moved_out_of_selected"),
        )
    )


def export_report(items: DataFrame, results: DataFrame, samples: DataFrame) -> DataFrame:
    """One row of export totals: files, bytes, objects, sampled rows."""
    one = F.lit(1).alias("k")
    files = items.agg(
        F.count(F.lit(1)).alias("generated_file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("generated_payload_bytes"),
    )
    objects = results.agg(F.count(F.lit(1)).alias("materialized_object_count"))
    rows = samples.agg(
        F.count(F.lit(1)).alias("sampled_table_count"),
        F.coalesce(F.sum("requested_count"), F.lit(0)).alias("sample_rows_requested"),
        F.coalesce(F.sum("actual_count"), F.lit(0)).alias("sample_rows_actual"),
    )
    return (
        files.select(one, "*").join(objects.select(one, "*"), "k").join(rows.select(one, "*"), "k").drop("k")
    )
