"""Keyed digests and the fakes and aliases built from them, as native expressions.

Only ``sha2``, ``concat``, ``split``, integer arithmetic and ``CASE`` are used, so a protected column
stays inside whole-stage code generation. The one exception is :func:`long_fake`, for values of
more than 19 digits; callers keep it in a projection of its own.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableguard.functions import fixed as X
from tableguard.functions.names import words_of
from tableguard.functions.values import as_col, check_digit, folded, java, stripped


class Key(NamedTuple):
    """Key of HMAC-SHA256: both padded 64-byte blocks in one binary column."""

    blocks: Column

    @property
    def inner(self) -> Column:
        return F.substring(self.blocks, 1, 64)

    @property
    def outer(self) -> Column:
        return F.substring(self.blocks, 65, 64)


def key_blocks(secret: bytes, scope: str = "") -> tuple[bytes, bytes]:
    """Padded blocks of a key. A scope derives an unlinkable key from the same secret."""
    if scope:
        secret = hashlib.sha256(secret + b"\0" + scope.encode()).digest()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    block = secret.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def literal_key(secret: bytes, scope: str = "") -> Key:
    """Key as a plan literal. It shows in explain output and logs: for tests only."""
    return Key(F.lit(b"".join(key_blocks(secret, scope))))


def key_table(spark: SparkSession, secret: bytes, scope: str = "") -> DataFrame:
    """One-row table holding the key blocks of a scope."""
    return spark.createDataFrame(pa.table({"blocks": [b"".join(key_blocks(secret, scope))]}))


def table_key(table: DataFrame) -> Key:
    """Key read from a one-row table when the query runs, so no key byte enters the plan.

    Both blocks travel in one subquery: Spark takes two subqueries over one local table for the
    same argument of a Python function.
    """
    return Key(table.select("blocks").scalar())


def hmac_hex(message: Column, key: Key) -> Column:
    first = F.unhex(F.sha2(F.concat(key.inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(key.outer, first), 256)


def keyed_digest(cls: Column | str, value: Column | str, key: Key) -> Column:
    """Hex digest of ``class|normalised value``; ``cls`` is a class name or a column of names."""
    c = F.lit(cls) if isinstance(cls, str) else cls
    return hmac_hex(F.concat(c, F.lit("|"), folded(value)), key)


SHORT_DIGITS = 18  # longest run taken by the unrolled form
SHORT_COUNT = SHORT_DIGITS + 1  # digits of the longest value written by it
LONG_DIGITS = 72  # longest run one digest can always supply
ALIAS_LENGTH = 10  # hex digits of an alias, unless another length is asked for
_CHUNK = 9  # decimal digits per chunk
_HEX = 15  # hex digits per limb: the most that fits a long
_BITS = 20  # bits per part of a limb: keeps every sum of products inside a long


def digest_limbs(digest: str) -> list[str]:
    """SQL of the five 60-bit limbs of a hex digest column, lowest first."""
    spans = [(max(0, stop - _HEX), stop) for stop in range(64, 0, -_HEX)]
    return [f"cast(conv(substring(`{digest}`, {a + 1}, {b - a}), 16, 10) as bigint)" for a, b in spans]


def limb_digits(limbs: list[str], k: int = SHORT_DIGITS) -> Column:
    """Last ``k`` <= 18 decimal digits of the number made of limbs.

    Two chunks of nine digits: 20-bit parts times the digits of their weights, plus the carry of
    the chunk below. SQL text keeps the many small terms to one call into the JVM.
    """
    per, mask = 60 // _BITS, (1 << _BITS) - 1
    parts = [f"(shiftright({limb}, {_BITS * i}) & {mask}L)" for limb in limbs for i in range(per)]
    base, chunks, carry = 10**_CHUNK, [], None
    for i in range(-(-k // _CHUNK)):
        weights = [(1 << (_BITS * j)) // base**i % base for j in range(len(parts))]
        terms = [f"{part} * {w}L" for part, w in zip(parts, weights) if w]
        total = " + ".join(terms if carry is None else [carry, *terms])
        chunks.insert(0, f"lpad(cast(({total}) % {base}L as string), {_CHUNK}, '0')")
        carry = f"(({total}) div {base}L)"
    return F.expr(f"right(concat({', '.join(chunks)}), {k})")


def digest_digits(digest: str, k: int = SHORT_DIGITS) -> Column:
    """Last ``k`` decimal digits (k <= 72) of a hex digest column read as one big integer."""
    if not 1 <= k <= LONG_DIGITS:
        raise ValueError(f"k must lie between 1 and {LONG_DIGITS}")
    if k > SHORT_DIGITS:
        return F.right(_all_digits(F.col(digest)), F.lit(k))
    return limb_digits(digest_limbs(digest), k)


def _div(a: Column, b: int) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def _all_digits(digest: Column) -> Column:
    """All digits of a digest, zero-padded to 81: one fold, for the rare very long value."""
    limbs = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.conv(F.substr(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("long"),
    )
    base = 10**_CHUNK

    def shift(chunks: Column, limb: Column) -> Column:
        start = F.struct(limb.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def step(state: Column, chunk: Column) -> Column:
            total = chunk * 65536 + state["carry"]
            return F.struct(
                _div(total, base).alias("carry"),
                F.concat(state["out"], F.array(total % F.lit(base))).alias("out"),
            )

        return F.aggregate(chunks, start, step)["out"]

    zeros = F.array_repeat(F.lit(0).cast("long"), 9)
    lowest_first = F.aggregate(limbs, zeros, shift)
    padded = F.transform(F.reverse(lowest_first), lambda c: F.lpad(c.cast("string"), _CHUNK, "0"))
    return F.when(digest.isNotNull(), F.array_join(padded, ""))


def _chained_digits(digest: Column, count: Column) -> Column:
    """Last ``count`` digits of the digest's number, its hash's number and so on, one after the other."""
    start = F.struct(digest.alias("seed"), F.lit("").alias("out"))

    def step(state: Column, _: Column) -> Column:
        number = F.ltrim(_all_digits(state["seed"]), F.lit("0"))
        more = F.struct(F.sha2(F.unhex(state["seed"]), 256).alias("seed"), F.concat(state["out"], number).alias("out"))
        return F.when(F.length(state["out"]) < count, more).otherwise(state)

    # A link adds 70 digits at least, but for a chance of one in 10^7.
    rounds = F.sequence(F.lit(1), _div(count.cast("long"), 70).cast("int") + 2)
    return F.right(F.aggregate(rounds, start, step)["out"], count)


def digit_count(v: Column) -> Column:
    return F.length(v) - F.length(F.regexp_replace(v, r"\p{Nd}", ""))


def overlay_digits(v: Column, fresh: Column, count: Column) -> Column:
    """Write ``count`` fresh digits over the digits of ``v`` and keep everything between them."""
    # Nearly all values are digits with one gap at most; that needs no list.
    size, ascii_digits = F.length(v), F.lit("0123456789")
    head = size - F.length(F.ltrim(v, ascii_digits))
    tail = size - F.length(F.rtrim(v, ascii_digits))
    gap = F.substr(v, head + 1, size - head - tail)
    split_once = F.concat(F.left(fresh, head), gap, F.right(fresh, tail))
    # More gaps: the pieces between the digits, with the new digits written out between them.
    pieces = F.split(v, r"\p{Nd}", -1)
    parts = [F.element_at(pieces, 1)]
    for i in range(1, SHORT_COUNT + 1):
        parts += [F.substring(fresh, i, 1), F.coalesce(F.get(pieces, F.lit(i)), F.lit(""))]
    return F.when(size == count, fresh).when(head + tail == count, split_once).otherwise(F.concat(*parts))


def long_fake(v: Column, digest: Column, count: Column) -> Column:
    """Fake of a value with any number of digits; null for one that the short form covers."""
    fresh = F.concat(F.lit("0"), _chained_digits(digest, count - 1))
    woven = F.zip_with(
        F.split(v, r"\p{Nd}", -1), F.split(fresh, ""), lambda s, d: F.concat(s, F.coalesce(d, F.lit("")))
    )
    return F.when(count > SHORT_COUNT, F.array_join(woven, ""))


def fresh_digits(digits: Column, count: Column) -> Column:
    """``count`` <= 19 new digits, the first one 0; ``digits`` holds the last 18 of a digest."""
    return F.concat(F.lit("0"), F.when(count > 1, F.right(digits, count - 1)).otherwise(""))


def fresh_thai_id(digits: Column) -> Column:
    """13 new digits with a valid check digit, the first one 0."""
    twelve = F.concat(F.lit("0"), F.right(digits, F.lit(11)))
    return F.concat(twelve, check_digit(twelve).cast("string"))


def write_digits(value: Column, fresh: Column, count: Column, long: Column | None = None) -> Column:
    """Fake of a value from its new digits; a value without digits is redacted.

    ``long`` is ``long_fake`` of the value, needed where it may have more than 19 digits.
    """
    out = F.when(value.isNull(), F.lit(None).cast("string")).when(count == 0, X.REDACTED)
    if long is not None:
        out = out.when(count > SHORT_COUNT, long)
    return out.otherwise(overlay_digits(value, fresh, count))


def fake_digits(value: Column, digest: str) -> Column:
    """Same punctuation, first digit 0, other digits from a digest column; no digit means redact.

    One expression for occasional use; ``operators.protect`` stages its parts as columns.
    """
    n = digit_count(value)
    return write_digits(value, fresh_digits(digest_digits(digest), n), n, long_fake(value, F.col(digest), n))


def fake_thai_id(value: Column, digest: str) -> Column:
    """13 digits with a valid check digit, starting with 0; other lengths become digit fakes."""
    n, digits = digit_count(value), digest_digits(digest)
    fresh = F.when(n == 13, fresh_thai_id(digits)).otherwise(fresh_digits(digits, n))
    return write_digits(value, fresh, n, long_fake(value, F.col(digest), n))


def alias(digest: Column, suffix: str = "", length: int = ALIAS_LENGTH) -> Column:
    return F.concat(F.lit("user_"), F.substring(digest, 1, length), F.lit(suffix))


def alias_collisions(df: DataFrame, value: Column | str, key: Key, cls: str = X.USERNAME, length: int = ALIAS_LENGTH) -> DataFrame:
    """How many distinct values share an alias of ``length`` hex digits with another one.

    Ten digits are 40 bits: expect one pair of values in common from about a million values on.
    """
    digests = df.select(keyed_digest(cls, value, key).alias("h")).where("h is not null").distinct()
    groups = digests.groupBy(F.substring("h", 1, length).alias("alias")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_shared"))


def pick(pool: list[str], digest: Column) -> Column:
    """Entry of a pool selected by the first 32 bits of a digest."""
    index = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(pool)
    return F.element_at(F.split(F.lit(" ".join(pool)), " "), (index + 1).cast("int"))


def name_digest(salt: str, raw: Column, key: Key) -> Column:
    message = F.concat(F.lit(f"{X.PERSONAL_NAME}|"), folded(F.concat(F.lit(f"{salt}|"), raw)))
    return hmac_hex(message, key)


def name_parts(column_name: str) -> str:
    """Which part of a fake name a column asks for: given, family or both."""
    words = words_of(column_name)
    hints = set(words) | {"".join(words)}
    if hints & set(X.GIVEN_HINTS):
        return "given"
    return "family" if hints & set(X.FAMILY_HINTS) else "both"


def name_source(value: Column) -> Column:
    """Struct of what a fake name is made from: script, text that is hashed, title and last name
    of a titled name."""
    v = stripped(value)
    thai = value.rlike("[ก-๏]")
    patterns = [java(f"^(?:{p})") for p in (X.THAI_NAME_RE, X.LATIN_NAME_RE)]

    def group(n: int) -> Column:
        t, l = (F.regexp_extract(v, p, n) for p in patterns)
        return F.when(thai, t).otherwise(l)

    whole = group(0)
    return F.struct(
        thai.alias("thai"),
        F.when(whole != "", whole).otherwise(value).alias("text"),
        group(1).alias("title"),
        group(3).alias("last"),
    )


def render_name(part: str, source: Column, given: Column, family: Column) -> Column:
    """Fake name from its source and the digests of the given and the family name."""
    thai, title = source["thai"], source["title"]
    first = F.when(thai, pick(X.THAI_GIVEN, given)).otherwise(pick(X.LATIN_GIVEN, given))
    second = F.when(thai, pick(X.THAI_FAMILY, family)).otherwise(pick(X.LATIN_FAMILY, family))
    both = F.concat(first, F.lit(" "), second)
    head = F.concat(title, F.when(thai, "").otherwise(" "))
    plain = {"given": first, "family": second, "both": both}[part]
    return F.when(title != "", F.concat(head, F.when(source["last"] != "", both).otherwise(first))).otherwise(plain)


def fake_name(column_name: str, value: Column, key: Key) -> Column:
    """Fake name in the script of the value; given, family or both as the column name asks.

    One expression for occasional use; ``operators.protect`` stages its parts as columns.
    """
    source = name_source(value)
    digests = [name_digest(salt, source["text"], key) for salt in ("given", "family")]
    return F.when(value.isNotNull(), render_name(name_parts(column_name), source, *digests))


def fake_titled_name(value: Column, key: Key) -> Column:
    """Titled name with its title kept and the names replaced; null when there is no title."""
    source = name_source(value)
    return F.when(source["title"] != "", fake_name("", value, key))
