"""Scanning and redaction of text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableguard.functions import fixed as X, scan as S, text as Tx

# File kinds whose content is checked for secrets, and the gate's error code.
CHECKED_SUFFIXES = (".sql", ".json", ".jsonl", ".yaml", ".md", ".csv")
RAW_SECRET = "RAW_SECRET_DETECTED"


def redact_corpus(df: DataFrame, text: str) -> DataFrame:
    """Text without secrets and with personal data marked, plus both counts."""
    staged = Tx.staged_secrets(df, text, "__tg_clean", "__tg_secrets")
    out = Tx.staged_pii(staged, "__tg_clean", "__tg_marked", "__tg_marks")
    marks = sum((F.col("__tg_marks")[c] for c in dict.fromkeys(c for c, _ in X.SCAN_ORDER)), F.lit(0))
    keep = [F.col("__tg_marked").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return out.select(*keep, F.col("__tg_secrets").alias("secrets"), F.when(F.col("__tg_marked").isNotNull(), marks).alias("marks"))


def personal_counts(df: DataFrame, text: str) -> DataFrame:
    """All columns but the text, and the marks of each class as a column."""
    marked = Tx.staged_pii(df, text, "__tg_marked", "__tg_marks")
    return marked.select(*[F.col(f"`{c}`") for c in df.columns if c != text], "__tg_marks.*")


def gated(df: DataFrame, text: str) -> DataFrame:
    """Every row with its redacted text, ``secrets_redacted`` and, where a secret is left, an
    ``error_code`` and no text. One pass over the rows."""
    staged = Tx.staged_secrets(df, text, "__tg_clean", "secrets_redacted")
    left = Tx.staged_secrets(staged, "__tg_clean", "__tg_again", "__tg_left")
    bad = F.coalesce(F.col("__tg_left") > 0, F.lit(False))
    shown = F.when(~bad, F.col("__tg_clean"))
    columns = [shown.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return left.select(*columns, "secrets_redacted", F.when(bad, RAW_SECRET).alias("error_code"))


def residual_gate(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) of ``gated``, for callers that need only one of them or keep both apart."""
    rows = gated(df, text)
    columns = [F.col(f"`{c}`") for c in df.columns if c != text]
    kept = rows.where(F.col("error_code").isNull()).select(*columns, F.col(f"`{text}`"), "secrets_redacted")
    skipped = rows.where(F.col("error_code").isNotNull()).select(*columns, F.lit("skipped_security").alias("status"), "error_code")
    return kept, skipped


def secret_findings(corpus: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files of the checked kinds that hold a secret, with the number of hits."""
    kind = F.lit(False)
    for suffix in CHECKED_SUFFIXES:
        kind = kind | F.col(path).endswith(suffix)
    hits = Tx.secret_count(F.col(content).cast("string"))
    return corpus.where(kind).select(path, hits.alias("n")).where("n > 0")


def pii_findings(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per personal value in a text: the keys, its class and its character range."""
    found = df.select(*keys, S.findings(text).alias("__tg_found"))
    return found.select(*keys, F.inline("__tg_found"))


def redact_log(df: DataFrame, message: str, kind: str = "driver") -> DataFrame:
    """Log lines without secrets. ``kind`` is ``driver`` or ``tool``."""
    others = [F.col(f"`{c}`") for c in df.columns if c != message]
    if kind == "driver":
        return df.select(*others, F.inline(F.array(Tx.driver_error(message))))
    return df.select(*others, Tx.tool_diagnostic(message).alias("diagnostics"))


def with_safe_message(df: DataFrame, message: str | Column) -> DataFrame:
    return df.withColumn("safe_message", Tx.safe_message(message))
