"""Content hashes of rows and of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableguard.functions import text as Tx
from tableguard.functions.values import as_col

def sha256_text(c: Column | str) -> Column:
    """``sha256:<hex>`` of a text or binary column."""
    return F.concat(F.lit("sha256:"), F.sha2(as_col(c), 256))


def joined(*cols: Column | str) -> Column:
    """Columns joined by NUL, nulls as empty text."""
    return F.concat_ws("\0", *[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols])


def sealed_digest(
    df: DataFrame, payload: Column, key: Column, by: list[str] | None = None, digits: int = 3, sums: dict[str, Column] | None = None
) -> DataFrame:
    """(by.., rows, digest, sums..): SHA-256 over sorted row hashes, collision-resistant.

    Rows fall into buckets by the first hex digits of the hash of their key (16^digits of them); each
    bucket's sorted row hashes are hashed, and then the buckets' hashes in order. So lists stay a
    bucket long, whatever the size of a group.
    """
    by, sums = list(by or []), dict(sums or {})
    hashed = df.select(
        *by, F.substring(F.sha2(F.coalesce(key, F.lit("")), 256), 1, digits).alias("__tg_bucket"), F.sha2(payload, 256).alias("__tg_row"),
        *[c.alias(f"__tg_sum_{n}") for n, c in sums.items()],
    )
    rows = F.sha2(F.array_join(F.array_sort(F.collect_list("__tg_row")), ""), 256)
    buckets = hashed.groupBy(*by, "__tg_bucket").agg(rows.alias("__tg_hash"), F.count(F.lit(1)).alias("__tg_n"), *[F.sum(f"__tg_sum_{n}").alias(f"__tg_sum_{n}") for n in sums])
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__tg_bucket", "__tg_hash"))), lambda b: F.concat(b["__tg_bucket"], b["__tg_hash"]))
    return buckets.groupBy(*by).agg(
        F.coalesce(F.sum("__tg_n"), F.lit(0)).alias("rows"),
        F.concat(F.lit("sha256:"), F.sha2(F.array_join(whole, ""), 256)).alias("digest"),
        *[F.coalesce(F.sum(f"__tg_sum_{n}"), F.lit(0)).alias(n) for n in sums],
    )


def object_fingerprint(
    schema: str = "schema_name", kind: str = "object_type", name: str = "object_name", modified: str = "modified_at"
) -> Column:
    return sha256_text(joined(schema, kind, name, modified))


def with_fingerprints(objects: DataFrame) -> DataFrame:
    return objects.withColumn("fingerprint", object_fingerprint())


def schema_fingerprint(objects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One hash per group (or for all) over object identities, or fingerprints where known."""
    known = [c for c in ("schema_name", "object_type", "object_name", "fingerprint") if c in objects.columns]
    sealed = sealed_digest(objects, joined(*known), joined(*known[:3]), by)
    return sealed.select(*(by or []), F.col("rows").alias("object_count"), F.col("digest").alias("schema_fingerprint"))


def definition_fingerprint(objects: DataFrame, definition: str = "definition") -> DataFrame:
    """Definition without secrets and personal literals, and the hash of that clean text."""
    clean, _ = Tx.redact_secrets(definition)
    staged = objects.withColumn(definition, clean)
    staged = staged.withColumn(definition, Tx.redact_pii_in_literals(definition)[0])
    return staged.withColumn("source_fingerprint", sha256_text(definition))
