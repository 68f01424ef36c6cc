"""The scalar, aggregate and window functions a protected select may use on public columns.

Most carry the same name in Spark. The others are mapped here, for use from Python
(:func:`call`) and, where the signature is fixed, as SQL functions (:func:`register`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

# Names usable on public columns.
SAME_NAME = (
    "avg count max min sum listagg string_agg "
    "dense_rank rank row_number percent_rank ntile lag lead first_value last_value "
    "abs ceiling floor round greatest least "
    "coalesce nullif nvl ifnull decode "
    "concat left right len length lower upper ltrim rtrim trim substring replace regexp_replace "
    "instr position "
    "current_date current_timestamp current_time dateadd datediff datepart date_trunc hour minute "
    "month year now to_date to_char"
).split()


def _json_path(*keys: Column) -> Column:
    return F.concat(F.lit("$"), *[F.concat(F.lit("."), k) for k in keys])


MAPPED: dict[str, Callable[..., Column]] = {
    "group_concat": lambda c, sep=None: F.listagg(c, F.lit(",") if sep is None else sep),
    "iif": lambda test, a, b: F.when(test, a).otherwise(b),
    "isnull": lambda a, b: F.ifnull(a, b),
    "cast": lambda c, to: c.cast(to),
    "convert": lambda to, c: c.cast(to),
    "try_cast": lambda c, to: c.try_cast(to),
    "try_convert": lambda to, c: c.try_cast(to),
    "strpos": lambda s, x: F.call_function("instr", s, x),
    "format": lambda c, pattern: F.date_format(c, pattern),
    "datename": lambda part, d: F.date_format(
        d, {"month": "MMMM", "weekday": "EEEE", "year": "yyyy", "day": "d"}[part.lower()]
    ),
    "getdate": lambda: F.current_timestamp(),
    "json_extract": lambda c, path: F.get_json_object(c, path),
    "json_query": lambda c, path: F.get_json_object(c, path),
    "json_value": lambda c, path: F.get_json_object(c, path),
    "jsonb_extract_path_text": lambda c, *keys: F.call_function("get_json_object", c, _json_path(*keys)),
}
ALLOWED = frozenset(SAME_NAME) | frozenset(MAPPED)


def call(name: str, *args) -> Column:
    """An allowed function by name; any other name is refused."""
    low = name.lower()
    if low in MAPPED:
        return MAPPED[low](*args)
    if low not in SAME_NAME:
        raise ValueError(f"function {name} is not on the allow list")
    return F.call_function(low, *[a if isinstance(a, Column) else F.lit(a) for a in args])


_SQL = {
    "strpos(s STRING, x STRING) RETURNS INT": "instr(s, x)",
    "getdate() RETURNS TIMESTAMP": "current_timestamp()",
    "json_value(j STRING, p STRING) RETURNS STRING": "get_json_object(j, p)",
    "json_query(j STRING, p STRING) RETURNS STRING": "get_json_object(j, p)",
    "json_extract(j STRING, p STRING) RETURNS STRING": "get_json_object(j, p)",
    "jsonb_extract_path_text(j STRING, k STRING) RETURNS STRING": "get_json_object(j, concat('$.', k))",
    "iif(test BOOLEAN, a STRING, b STRING) RETURNS STRING": "if(test, a, b)",
}


def register(spark: SparkSession) -> None:
    """Make the mapped names with a fixed signature available to ``spark.sql``."""
    for signature, body in _SQL.items():
        name, rest = signature.split("(", 1)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({rest} RETURN {body}")
