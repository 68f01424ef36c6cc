"""Stable snapshot aliases kept in a registry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableguard.functions import fixed as X
from tableguard.functions.keyed import Key, hmac_hex
from tableguard.functions.values import as_col, folded

#: Characters of an alias at first, at each step beyond, and of a whole encoding.
CODE, STEP, _FULL = 10, 2, 52


def alias_digest(value: Column | str, key: Key) -> Column:
    return hmac_hex(folded(value), key)


def encode_digest(digest: Column | str) -> Column:
    """Digest as 52 characters of the alias alphabet: 13 groups of 20 bits, highest first."""
    padded = F.concat(F.lit("0"), as_col(digest))
    standard = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    groups = [
        F.lpad(F.translate(F.conv(F.substring(padded, 5 * i + 1, 5), 16, 32), standard, X.ALIAS_ALPHABET), 4, "0")
        for i in range(13)
    ]
    return F.concat(*groups)


def _length_apart(a: Column, b: Column) -> Column:
    """Shortest allowed length at which two encodings differ."""
    out = None
    for n in range(CODE, _FULL + 1, STEP):
        differ = F.substring(a, 1, n) != F.substring(b, 1, n)
        out = F.when(differ, n) if out is None else out.when(differ, n)
    return F.coalesce(F.when(b.isNull(), CODE).otherwise(out), F.lit(CODE))


def alias_registry(values: DataFrame, registry: DataFrame, key: Key) -> DataFrame:
    """Rows to append to a registry ``(class, digest, alias)`` for values it does not hold yet.

    ``values`` has ``class, value``. Registered aliases never change. New digests that share a
    ten-character prefix with each other or with a registered digest all get longer aliases, so
    the result does not depend on row order. Groups are prefixes of a uniform hash and therefore
    tiny, whatever the skew of the values.
    """
    wanted = (
        values.where(F.col("value").isNotNull())
        .select("class", alias_digest("value", key).alias("digest"))
        .distinct()
    )
    return register(wanted, registry)


def register(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows to append to a registry for the (class, digest) it does not hold yet."""
    new = wanted.join(registry.select("class", "digest"), ["class", "digest"], "left_anti")
    # Encodings that share ten characters share eleven hex digits of the digest, so only those
    # registered digests matter; the work after this depends on the new values alone.
    near = F.substring("digest", 1, 11).alias("__tg_near")
    rivals = registry.select("class", "digest", near).join(new.select("class", near).distinct(), ["class", "__tg_near"], "left_semi")
    both = new.select("class", "digest", F.lit(True).alias("fresh")).unionByName(
        rivals.select("class", "digest", F.lit(False).alias("fresh"))
    )
    coded = both.withColumn("code", encode_digest("digest"))
    group = Window.partitionBy("class", F.substring("code", 1, CODE)).orderBy("code")
    length = F.greatest(
        _length_apart(F.col("code"), F.lag("code").over(group)),
        _length_apart(F.col("code"), F.lead("code").over(group)),
    )
    sized = coded.withColumn("length", length).where("fresh")
    suffix = F.when(F.col("class") == X.EMAIL, X.EMAIL_SUFFIX).otherwise("")
    text = F.concat(F.lit("user_"), F.substr("code", F.lit(1), F.col("length")), suffix)
    return sized.select("class", "digest", text.alias("alias"))


def apply_aliases(df: DataFrame, column: str, cls: str, registry: DataFrame, key: Key) -> DataFrame:
    """Replace a column by its registered alias; null stays null."""
    return salted_alias(df, column, cls, registry, key)


def salted_alias(df: DataFrame, column: str, cls: str, registry: DataFrame, key: Key, salts: int = 16) -> DataFrame:
    """Replace a column by its registered alias; null stays null.

    The registry's rows are repeated ``salts`` times, and each partition of the rows meets one of
    the copies, so a hot value spreads over as many tasks. Nulls get keys of their own that match
    nothing, one per partition.
    """
    own = registry.where(F.col("class") == cls).select(
        F.col("digest").alias("__tg_digest"), F.col("alias").alias("__tg_alias"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__tg_salt")
    )
    nothing = F.concat(F.lit("null "), F.spark_partition_id().cast("string"))
    keyed = df.withColumns({
        "__tg_key": F.coalesce(alias_digest(F.col(f"`{column}`").cast("string"), key), nothing),
        "__tg_own": F.pmod(F.spark_partition_id(), F.lit(salts)),
    })
    same = (F.col("__tg_key") == F.col("__tg_digest")) & (F.col("__tg_own") == F.col("__tg_salt"))
    return keyed.join(own, same, "left").select(
        *[F.col("__tg_alias").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    )
