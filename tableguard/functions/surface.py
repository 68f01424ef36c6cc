"""The library's functions for SQL text: a table function of findings, and scanners as functions.

``register(spark, key_table)`` makes them temporary functions of a session. The key stays in the
one-row table it came in: SQL functions read it there when a query runs, so no statement holds it.

========================================  =====================================================
``pii_findings(text)``                    table function: class, start, end of each personal value
``scan_text(text)``                       text with every personal value replaced
``protect_json(text, name)``              JSON text protected key by key; null for other text
``declaration_surface(text)``             SQL text with literals and comments blanked
========================================  =====================================================

A null text has no findings and gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableguard.functions.scan import Replacer, class_of, may_match, replaced, spans, walked
from tableguard.operators.corpus import visible

#: View of the key table that the SQL functions read.
KEY_VIEW = "tableguard_key"


class Findings:
    """Rows of one text, by place."""

    def eval(self, text: str | None) -> Iterator[tuple[str, int, int]]:
        if text is not None and may_match(text):
            for start, end, number, _ in spans(text):
                yield class_of(number), start, end


def register(spark: SparkSession, keys: DataFrame) -> None:
    keys.createOrReplaceTempView(KEY_VIEW)
    spark.udtf.register("pii_findings", F.udtf(Findings, returnType="class string, start int, end int", useArrow=True))

    @F.arrow_udf("string")
    def scanned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from replaced(batches, Replacer.text, {})

    @F.arrow_udf("string")
    def protected(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        replacer = None
        for values, names, blocks in batches:
            if replacer is None and len(values):
                replacer = Replacer(blocks[0].as_py(), {})
            yield pa.array([walked(replacer, n or "", v) for v, n in zip(values.to_pylist(), names.to_pylist())], pa.string())

    spark.udf.register("tableguard_scanned", scanned)
    spark.udf.register("tableguard_walked", protected)
    spark.udf.register("tableguard_visible", visible)
    blocks = f"(SELECT blocks FROM {KEY_VIEW})"
    for signature, body in {
        "scan_text(t STRING) RETURNS STRING": f"tableguard_scanned(t, {blocks})",
        "protect_json(t STRING, name STRING) RETURNS STRING": f"tableguard_walked(t, name, {blocks})",
        "declaration_surface(t STRING) RETURNS STRING": "coalesce(tableguard_visible(t), t)",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
