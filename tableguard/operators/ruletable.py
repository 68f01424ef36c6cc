"""First-pass rules as a table: any number of rules, one plan.

Exact names, schemas and prefixes meet the rules by equality: an object asks for its name, its schema
and its beginnings of the lengths that prefixes have. Comment keywords are found by an Aho-Corasick
automaton that tasks build from a broadcast list; a list beyond ``most_bytes`` is dealt into several
that are searched one after the other. Matches are those of ``objects.pass1_matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tableguard.operators.objects import COMMENT, EXACT, PREFIX, SCHEMA
from tableguard.sources.rules import Rules

#: Bytes of keywords that are broadcast at once.
MOST_BYTES = 16 << 20

_EXACT, _PREFIX, _SCHEMA, _SAID = "configured_exact", "configured_prefix", "configured_schema", "comment"
_RANKED = (_EXACT, _PREFIX, _SCHEMA, _SAID)
_TABLE = "category string, kind string, pattern string"


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """category, kind and pattern (names in upper, schemas and keywords in lower case)."""
    rows = []
    for rule in rules.categories:
        rows += [(rule.name, _EXACT, n.upper()) for n in rule.exact_names]
        rows += [(rule.name, _PREFIX, p.upper()) for p in rule.prefixes]
        rows += [(rule.name, _SCHEMA, s.lower()) for s in rule.schemas]
        rows += [(rule.name, _SAID, k.lower()) for k in rule.comment_keywords]
    return spark.createDataFrame(rows, _TABLE).distinct()


def _keyword_lists(table: DataFrame, most_bytes: int) -> Iterator[list[str]]:
    """Keywords in lists of about ``most_bytes`` at most."""
    words = table.where(F.col("kind") == _SAID).select("pattern").where("pattern <> ''").distinct()
    size = words.agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    lists = -(-size // most_bytes)
    for i in range(lists):
        yield [r.pattern for r in words.where(F.pmod(F.xxhash64("pattern"), F.lit(lists)) == i).collect()]


def _found(texts: Column, spark: SparkSession, words: list[str]) -> Column:
    """Array of the words a text contains."""
    held = spark.sparkContext.broadcast(words)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in held.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for values in batches:
            yield pa.array([None if v is None else sorted({w for _, w in automaton.iter(v)}) for v in values.to_pylist()], pa.list_(pa.string()))

    return run(texts)


def table_matches(objects: DataFrame, table: DataFrame, with_comment: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per (object, matching category), the strongest kind of match first."""
    spark = objects.sparkSession
    # As many numbers as prefixes have lengths, which names bound.
    lengths = [r[0] for r in table.where(F.col("kind") == _PREFIX).select(F.length("pattern")).distinct().collect()]
    name, schema = F.upper("object_name").alias("name"), F.lower("schema_name").alias("schema")
    rows = objects.select("object_id", name, schema, F.lower(F.coalesce(F.col("native_comment"), F.lit(""))).alias("said"))
    starts = F.transform(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: F.when(F.length("name") >= n, F.substr("name", F.lit(1), n)))
    asked = rows.select("object_id", "name", "schema", F.explode(F.array_compact(F.concat(
        F.array(F.struct(F.lit(_EXACT).alias("kind"), F.col("name").alias("pattern")), F.struct(F.lit(_SCHEMA).alias("kind"), F.col("schema").alias("pattern"))),
        F.transform(starts, lambda p: F.struct(F.lit(_PREFIX).alias("kind"), p.alias("pattern"))),
    ))).alias("one")).select("object_id", "name", "schema", "one.kind", "one.pattern")
    if with_comment:
        lists = [_found(F.col("said"), spark, words) for words in _keyword_lists(table, most_bytes)]
        words = F.concat(F.array(F.lit("")), *lists)  # every comment contains the empty word
        asked = asked.unionByName(rows.select("object_id", "name", "schema", F.lit(_SAID).alias("kind"), F.explode(words).alias("pattern")))
    met = asked.join(table, ["kind", "pattern"])
    rank = F.array_position(F.array(*map(F.lit, _RANKED)), F.col("kind"))
    best = met.groupBy("object_id", "category").agg(F.min(F.struct(rank.alias("rank"), "kind", "name", "schema")).alias("m"))
    kind = F.col("m.kind")

    def by_kind(*values: Column) -> Column:
        out = F.when(kind == _RANKED[0], values[0])
        for k, v in zip(_RANKED[1:], values[1:]):
            out = out.when(kind == k, v)
        return out

    return best.select(
        "object_id", "category", by_kind(*(F.lit(x) for x in (EXACT, PREFIX, SCHEMA, COMMENT))).cast("double").alias("confidence"), kind.alias("kind"),
        by_kind(
            F.concat(F.lit("exact name "), F.col("m.name")), F.concat(F.lit("configured prefix for "), F.col("m.name")),
            F.concat(F.lit("configured schema "), F.col("m.schema")), F.lit("sanitized native comment"),
        ).alias("summary"),
        (kind != _SAID).alias("authoritative"), F.lit(1).alias("seq"),
    )
