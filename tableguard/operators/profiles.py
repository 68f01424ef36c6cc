"""Profiles that merge: stored per part of a table, added up without reading rows again.

A part is a row per (by.., column, class) with its count, shortest and longest value, a sketch of
the distinct values (HyperLogLog) and one of the most frequent ones. Frequent values are kept for
public columns' public values only, so a stored profile holds nothing that is protected. Sketches
have a fixed size, so a profile is as small after a year as after a day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableguard.functions import fixed as X, names as N, values as V

#: Size of the sketches: relative error about 1.04 / sqrt(2^LG_K), and values tracked for the most frequent.
LG_K, TRACKED = 12, 1000


def profile_parts(df: DataFrame, by: Sequence[str] = (), policy: Mapping[str, str] | None = None) -> DataFrame:
    """by.., column_name, class, n, shortest, longest, distinct_sketch, frequent_sketch of every text
    column that is not in ``by``. Nulls are not counted."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in by]
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), V.classify_value(F.col(f"`{c}`")).alias("class"), F.col(f"`{c}`").alias("v"),
            F.lit(N.declared_class(c, policy) == X.PUBLIC).alias("shown"),
        )
        for c in columns
    ])
    rows = df.select(*by, F.inline(cells)).where("v is not null")
    frequent = F.when(F.col("shown") & (F.col("class") == X.PUBLIC), F.col("v"))
    return rows.select("*", frequent.alias("frequent")).groupBy(*by, "column_name", "class").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.length("v")).alias("shortest"),
        F.max(F.length("v")).alias("longest"),
        F.hll_sketch_agg("v", LG_K).alias("distinct_sketch"),
        F.expr(f"approx_top_k_accumulate(frequent, {TRACKED})").alias("frequent_sketch"),
    )


def _merged() -> list[Column]:
    return [
        F.sum("n").alias("n"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr(f"approx_top_k_combine(frequent_sketch, {TRACKED})").alias("frequent_sketch"),
    ]


def merge_profiles(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parts added up to fewer ``by`` columns; the result is a part again."""
    return parts.groupBy(*by, "column_name", "class").agg(*_merged())


def rollup_profiles(parts: DataFrame, *levels: str) -> DataFrame:
    """Parts added up along ``levels`` (as table, column, class), with a row for each level and all;
    ``level`` is the number of columns that are not added up."""
    grouped = parts.rollup(*levels).agg(*_merged(), F.grouping_id().alias("gid"))
    # The grouping id has a one for each column added up, from the right.
    return grouped.withColumn("level", F.lit(len(levels)) - F.bit_count("gid")).drop("gid")


def estimated(parts: DataFrame, most_frequent: int = 5) -> DataFrame:
    """Parts with numbers in place of the sketches: distinct values and the most frequent ones."""
    return parts.withColumns({
        "distinct_values": F.hll_sketch_estimate("distinct_sketch"),
        "most_frequent": F.expr(f"approx_top_k_estimate(frequent_sketch, {most_frequent})"),
    }).drop("distinct_sketch", "frequent_sketch")
