"""Redaction of secrets and personal data in text, as native regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableguard.functions import fixed as X
from tableguard.functions.values import as_col, java, stripped

_ASSIGN = java(X.SECRET_ASSIGNMENT_RE, "iud")
_BEARER = java(X.BEARER_RE, "iu")
_PEM = java(X.PRIVATE_KEY_RE, "s")
_MARK_CLASSES = "EMAIL|CREDIT_CARD|NATIONAL_ID|PHONE|PERSONAL_NAME"
_MARKS = rf"\[REDACTED:(?:{_MARK_CLASSES})\]"


# Cheap tests a text must pass before a pattern can match in it. Most documents pass none, so
# the expensive patterns only run where they may find something. Marks hold no hint, so a test
# of the original text also covers the text between two replacements.
_NUMBER = "[0-9][0-9 ()-]{6,}[0-9]"


def _secret_hint(c: Column) -> Column:
    return c.rlike(java(r"=\s*['\"]")) | c.rlike(java(r"bearer\s", "iu")) | c.contains("PRIVATE KEY-----")


def _pii_hint(c: Column) -> Column:
    return c.contains("@") | c.rlike(f"{_NUMBER}|[ก-๏]{{2}}|(?:Mr|Ms|Miss|Dr)")


def _none_or_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), 0)


def redact_secrets(c: Column | str) -> tuple[Column, Column]:
    """(text without secrets, number of secrets): assignments, bearer tokens, private keys."""
    t0 = as_col(c)
    t1 = F.regexp_replace(t0, _ASSIGN, "$1='[REDACTED]'")
    t2 = F.regexp_replace(t1, _BEARER, X.REDACTED)
    t3 = F.regexp_replace(t2, _PEM, X.REDACTED)
    n = (
        F.regexp_count(t0, F.lit(_ASSIGN))
        + F.regexp_count(t1, F.lit(_BEARER))
        + F.regexp_count(t2, F.lit(_PEM))
    )
    hint = _secret_hint(t0)
    return F.when(hint, t3).otherwise(t0), F.when(hint, n).otherwise(_none_or_zero(t0))


def staged_secrets(df: DataFrame, text: str, clean: str, count: str) -> DataFrame:
    """``redact_secrets`` of a column as two more columns, one replacement per projection.

    Every running text is a column, so each pattern stands in the plan once for its count and once
    for its replacement.
    """
    hint, running = f"{clean}_hint", F.col(text)
    df = df.withColumn(hint, _secret_hint(running))
    for i, (pattern, mark) in enumerate(((_ASSIGN, "$1='[REDACTED]'"), (_BEARER, X.REDACTED), (_PEM, X.REDACTED))):
        n = F.when(F.col(hint), F.regexp_count(running, F.lit(pattern))).otherwise(_none_or_zero(running))
        after = F.when(F.col(hint), F.regexp_replace(running, pattern, mark)).otherwise(running)
        df = df.select("*", n.alias(f"{count}_{i}"), after.alias(f"{clean}_{i}"))
        running = F.col(f"{clean}_{i}")
    total = F.col(f"{count}_0") + F.col(f"{count}_1") + F.col(f"{count}_2")
    helpers = [hint, *(f"{x}_{i}" for x in (clean, count) for i in range(3))]
    return df.withColumns({clean: running, count: total}).drop(*helpers)


def staged_pii(df: DataFrame, text: str, clean: str, counts: str) -> DataFrame:
    """Marked text and marks per class (a struct), one pattern per projection."""
    hint, running = f"{clean}_hint", F.col(text)
    df = df.withColumn(hint, _pii_hint(running))
    found: dict[str, list[str]] = {}
    for i, (cls, pattern) in enumerate(X.SCAN_ORDER):
        n = F.when(F.col(hint), F.regexp_count(running, F.lit(java(pattern)))).otherwise(_none_or_zero(running))
        after = F.when(F.col(hint), F.regexp_replace(running, java(pattern), f"[REDACTED:{cls.upper()}]")).otherwise(running)
        df = df.select("*", n.alias(f"{counts}_{i}"), after.alias(f"{clean}_{i}"))
        found.setdefault(cls, []).append(f"{counts}_{i}")
        running = F.col(f"{clean}_{i}")
    sums = [sum((F.col(c) for c in names[1:]), F.col(names[0])).alias(cls) for cls, names in found.items()]
    helpers = [hint, *(f"{x}_{i}" for x in (clean, counts) for i in range(len(X.SCAN_ORDER)))]
    return df.withColumns({clean: running, counts: F.struct(*sums)}).drop(*helpers)


def secret_count(c: Column | str) -> Column:
    return redact_secrets(c)[1]


def redact_pii(c: Column | str) -> tuple[Column, Column]:
    """(text with ``[REDACTED:<CLASS>]`` marks, number of marks added)."""
    before = as_col(c)
    after = before
    for cls, pattern in X.SCAN_ORDER:
        after = F.regexp_replace(after, java(pattern), f"[REDACTED:{cls.upper()}]")
    n = F.regexp_count(after, F.lit(_MARKS)) - F.regexp_count(before, F.lit(_MARKS))
    hint = _pii_hint(before)
    return F.when(hint, after).otherwise(before), F.when(hint, n).otherwise(_none_or_zero(before))


def pii_counts(c: Column | str) -> dict[str, Column]:
    """Marks each pattern would add on the running text, by class."""
    before = as_col(c)
    text, hint = before, _pii_hint(before)
    out: dict[str, Column] = {}
    for cls, pattern in X.SCAN_ORDER:
        n = F.regexp_count(text, F.lit(java(pattern)))
        out[cls] = out[cls] + n if cls in out else n
        text = F.regexp_replace(text, java(pattern), f"[REDACTED:{cls.upper()}]")
    return {cls: F.when(hint, n).otherwise(_none_or_zero(before)) for cls, n in out.items()}


def _interleave(text: Column, literals: Column, pattern: str) -> Column:
    """Put rewritten matches back between the pieces the pattern cuts out of ``text``."""
    pieces = F.split(text, pattern, -1)
    woven = F.zip_with(pieces, literals, lambda p, q: F.concat(p, F.coalesce(q, F.lit(""))))
    return F.array_join(woven, "")


def redact_pii_in_literals(c: Column | str) -> tuple[Column, Column]:
    """Marks only inside single-quoted SQL literals; code outside them is left alone."""
    text = as_col(c)
    found = F.regexp_extract_all(text, F.lit(X.STRING_LITERAL_RE), 0)
    clean = F.transform(found, lambda s: redact_pii(s)[0])
    counts = F.aggregate(F.transform(found, lambda s: redact_pii(s)[1]), F.lit(0), lambda a, b: a + b)
    has = text.contains("'")
    # A leading match makes split() drop nothing here, since the limit is negative.
    return (
        F.when(has, _interleave(text, clean, X.STRING_LITERAL_RE)).otherwise(text),
        F.when(has, counts).otherwise(F.when(text.isNotNull(), 0)),
    )


def one_line(c: Column | str) -> Column:
    """Runs of white space become one space and the ends are trimmed."""
    return stripped(F.regexp_replace(as_col(c), r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def safe_message(c: Column | str, limit: int | None = 200) -> Column:
    """Short failure reason without SQL bodies, secrets or absolute paths; no limit keeps it whole."""
    text = F.regexp_replace(one_line(c), java(X.SQL_BODY_RE, "isu"), X.REDACTED)
    text, _ = redact_secrets(text)
    text = F.regexp_replace(text, java(X.ABSOLUTE_PATH_RE), X.REDACTED)
    if limit is not None:
        cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1), F.lit(X.WHITESPACE)), F.lit("…"))
        text = F.when(F.length(text) > limit, cut).otherwise(text)
    return F.when(text == "", "No sanitized reason is available.").otherwise(text)


def driver_error(c: Column | str, limit: int | None = 1000) -> Column:
    """Driver message: one line, connection secrets removed, at most ``limit`` characters, and all
    native error numbers of the whole message."""
    text = F.regexp_replace(one_line(c), java(X.CONNECTION_SECRET_RE, "iu"), "$1=<redacted>")
    numbers = F.regexp_extract_all(text, F.lit(X.NATIVE_ERROR_RE), 1).cast("array<int>")
    shown = text if limit is None else F.substring(text, 1, limit)
    return F.struct(shown.alias("message"), numbers.alias("native_errors"))


def tool_diagnostic(c: Column | str, limit: int | None = 512) -> Column:
    """Tool output without secrets or quoted values, bounded unless there is no limit, with a hash
    of the raw text."""
    raw = stripped(c)
    text = F.regexp_replace(raw, java(X.TOOL_SECRET_RE, "iu"), "$1=[REDACTED]")
    found = F.regexp_extract_all(text, F.lit(X.QUOTED_LITERAL_RE), 0)
    marks = F.transform(
        found, lambda s: F.concat(F.lit("'<redacted "), F.length(s).cast("string"), F.lit(" chars>'"))
    )
    text = F.translate(_interleave(text, marks, X.QUOTED_LITERAL_RE), "\r\n", "  ")
    mark = F.concat(F.lit("diagnostic fingerprint: "), F.substring(F.sha2(raw, 256), 1, 12))
    if limit is None:
        lines = F.array(text, mark)
    else:
        size = F.length(text)
        cut = F.concat(
            F.lit(f"diagnostic truncated: showing {limit} of "), size.cast("string"), F.lit(" characters")
        )
        lines = F.array_compact(F.array(F.substring(text, 1, limit), F.when(size > limit, cut), mark))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(lines)
