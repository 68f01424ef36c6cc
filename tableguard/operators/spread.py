"""Left joins whose many rows may share one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Tasks that the rows of one key are spread over.
SALTS = 16


def spread_left_join(rows: DataFrame, facts: DataFrame, key: str, salts: int = SALTS, long: bool = False) -> DataFrame:
    """``rows`` left-joined to ``facts``, a narrow table with one row per ``key``.

    Every row goes to one of ``salts`` copies of the facts by the hash of the whole row, so the rows
    of a hot key, and those without a key, spread over as many tasks; repeated executions of a task
    choose the same copy. The copies cost ``salts`` narrow rows per different key. Spark's size
    estimate leaves them out, so facts whose number grows with the data are ``long``: their copies
    are dealt out and hashed by the tasks, never broadcast through the driver.
    """
    rows = rows.withColumn("__tg_salt", own_copy(*rows.columns, salts=salts))
    return rows.join(salted(facts, salts, long), [key, "__tg_salt"], "left").drop("__tg_salt")


def own_copy(*by: str, salts: int = SALTS) -> Column:
    """The copy of the facts that a row meets, by the hash of these columns."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.lit(salts)).cast("int")


def salted(facts: DataFrame, salts: int = SALTS, long: bool = False) -> DataFrame:
    """The copies of the facts, told apart by ``__tg_salt``."""
    copies = facts.withColumn("__tg_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return copies.hint("shuffle_hash") if long else copies


def own_if_null(key: Column, *row: Column | str) -> Column:
    """The key, or a text that no key equals and that differs from row to row if it is null."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*row).cast("string")))
