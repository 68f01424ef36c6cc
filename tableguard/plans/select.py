"""Protected select: a read path that masks by lineage and refuses inference.

A request is structured; its expressions are ordinary Spark SQL expressions. Each is parsed once
by the session's own parser and checked as a tree. The request is first built over empty tables of the
same columns, and Spark's analysed plan tells by expression id where every output comes from and
which columns filter, join, sort or group. Only then is it built over the rows, from the same trees.
No row is read before the request is known to be safe.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tableguard.functions import fixed as X, names as N, values as V
from tableguard.functions.keyed import Key
from tableguard.operators.protect import protect
from tableguard.plans.lineage import Origin, Trace, trace
from tableguard.plans.parsed import Names, Ordered, Parsed, Reader, RefusedExpression

__all__ = [
    "Join", "Policy", "RefusedExpression", "Request", "RestrictedUse", "bound", "lineage", "mask", "output_policy", "protected_rows",
    "protected_select", "protected_write", "resolve", "shaped",
]

# Usual limits of one answer; every one is a parameter, and None lifts it.
DEFAULT_ROWS, MAX_ROWS, MAX_COLUMNS, MAX_BYTES = 100, 500, 50, 256 * 1024
#: Classes that are shown in part: any computation could undo that.
GENERALISED = frozenset({X.ADDRESS, X.DATE_OF_BIRTH, X.PRECISE_LOCATION})


class RestrictedUse(ValueError):
    """A protected column is used where its values could be inferred."""

    def __init__(self, columns: list[str]) -> None:
        super().__init__(f"protected columns may only be selected directly: {', '.join(columns)}")
        self.columns = columns


@dataclass(frozen=True)
class Join:
    """A joined table, by a condition or by the columns both sides share."""

    table: str
    on: str = ""
    how: str = "inner"
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Request:
    """What to read. ``select`` holds expressions, each optionally with `` AS alias``."""

    table: str
    select: tuple[str, ...]
    joins: tuple[Join, ...] = ()
    where: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    having: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    distinct: bool = False
    max_rows: int = DEFAULT_ROWS
    value_mode: str = "short"
    ctes: Mapping[str, "Request"] = field(default_factory=dict)
    union_all: tuple["Request", ...] = ()


@dataclass(frozen=True)
class Policy:
    """Class of one output column, the source it follows, and whether that is forced."""

    cls: str
    source: str
    forced: bool


class _Quiet(logging.Filter):
    """Drops what the thread logs while a request is tried."""

    def __init__(self) -> None:
        super().__init__()
        self.local = threading.local()

    def filter(self, record: logging.LogRecord) -> bool:
        return not getattr(self.local, "on", False)


_QUIET = _Quiet()


@contextmanager
def _trying() -> Iterator[None]:
    """A request that does not resolve is an answer, so it does not belong into the log."""
    for name in ("SQLQueryContextLogger", "DataFrameQueryContextLogger"):
        PySparkLogger.getLogger(name).addFilter(_QUIET)  # a filter is added once only
    _QUIET.local.on = True
    try:
        yield
    except AnalysisException as error:
        raise ValueError("the request does not resolve") from error
    finally:
        _QUIET.local.on = False


@dataclass
class _Table:
    df: DataFrame
    classes: dict[str, str]


@dataclass(frozen=True)
class _Read:
    """A request, parsed."""

    select: list[tuple[str, Parsed]]
    on: dict[str, Parsed]
    where: list[Parsed]
    group_by: list[Parsed]
    having: list[Parsed]
    order_by: list[Ordered]

    @property
    def grouped(self) -> bool:
        return bool(self.group_by or self.having)

    def output(self, value: Parsed) -> int | None:
        """Place of the output that a sort key of a grouped request names or repeats."""
        if len(value.plain) == 1:
            for i, (name, _) in enumerate(self.select):
                if name.lower() == value.plain[0].lower():
                    return i
        return next((i for i, (_, e) in enumerate(self.select) if e.same(value)), None)


def _hides(join: Join) -> bool:
    """Semi and anti joins do not add columns, so their tables cannot be selected from."""
    return "semi" in join.how.lower() or "anti" in join.how.lower()


def _items(reader: Reader, texts: tuple[str, ...], tables: Mapping[str, _Table]) -> list[tuple[str, Parsed]]:
    """(output name, expression) of the select items; stars become their columns."""
    out = []
    for text in texts:
        star = reader.star(text)
        if star is None:
            parsed = reader.value(text)
            out.append((parsed.name or (parsed.plain[-1] if parsed.plain else text), parsed))
            continue
        chosen = [n for n in tables if not star or n.lower() == star[-1].lower()]
        if len(star) > 1 or not chosen:
            raise ValueError(f"no table of that name: {text}")
        out += [(c, reader.column_of(n, c)) for n in chosen for c in tables[n].df.columns]
    return out


def _read(spark: SparkSession, request: Request, tables: Mapping[str, _Table]) -> _Read:
    reader = Reader(spark, Names({n.lower(): frozenset(c.lower() for c in t.df.columns) for n, t in tables.items()}))
    hidden = {j.table for j in request.joins if _hides(j)}
    select = _items(reader, request.select, {n: t for n, t in tables.items() if n not in hidden})
    names = [n for n, _ in select]
    for name in names:
        if names.count(name) > 1:
            raise ValueError(f"output column {name} is named twice")
    outputs = frozenset(n.lower() for n in names)
    return _Read(
        select,
        {j.table: reader.condition(j.on) for j in request.joins if not j.using},
        [reader.condition(w) for w in request.where],
        [reader.key(g) for g in request.group_by],
        [reader.condition(h) for h in request.having],
        [reader.order(o, outputs) for o in request.order_by],
    )


def _build(request: Request, read: _Read, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The raw relational part of a request, as ordinary DataFrame operations."""
    df = frames[request.table].alias(request.table)
    spark = df.sparkSession

    def column(parsed: Parsed) -> Column:
        return parsed.column(spark)

    for j in request.joins:
        df = df.join(frames[j.table].alias(j.table), list(j.using) if j.using else column(read.on[j.table]), j.how)
    for w in read.where:
        df = df.where(column(w))
    if not read.grouped:
        # Sorting after the projection resolves aliases and still sees the input columns.
        df = df.select(*[column(e).alias(n) for n, e in read.select])
        df = df.distinct() if request.distinct else df
        return df.orderBy(*[o.directed(column(o.value)) for o in read.order_by]) if read.order_by else df
    # What is sorted by is an output, or computed along with the groups.
    places = [read.output(o.value) for o in read.order_by]
    grouped = df.groupBy(*[column(g).alias(f"__g{i}") for i, g in enumerate(read.group_by)]).agg(
        *[column(e).alias(f"__s{i}") for i, (_, e) in enumerate(read.select)],
        *[column(h).alias(f"__h{i}") for i, h in enumerate(read.having)],
        *[column(o.value).alias(f"__o{i}") for i, o in enumerate(read.order_by) if places[i] is None],
    )
    for i in range(len(read.having)):
        grouped = grouped.where(F.col(f"__h{i}"))
    outputs = [f"__s{i}" for i in range(len(read.select))]
    if request.distinct:
        if None in places:
            raise ValueError("distinct rows are sorted by what is selected")
        grouped = grouped.select(*outputs).distinct()
    if read.order_by:
        keys = [F.col(f"__o{i}" if places[i] is None else f"__s{places[i]}") for i in range(len(places))]
        grouped = grouped.orderBy(*[o.directed(k) for o, k in zip(read.order_by, keys)])
    return grouped.select(*[F.col(s).alias(n) for s, (n, _) in zip(outputs, read.select)])


def _empty(spark: SparkSession, tables: Mapping[str, _Table]) -> dict[str, DataFrame]:
    """Tables of the same columns without rows, each with expression ids of its own."""
    nothing = spark._jvm.java.util.ArrayList()
    return {n: DataFrame(spark._jsparkSession.createDataFrame(nothing, t.df._jdf.schema()), spark) for n, t in tables.items()}


def lineage(tables: Mapping[str, DataFrame], select: list[str]) -> dict[str, list[str] | None]:
    """Output name to the source columns it is computed from; None is unknown."""
    held = {n: _Table(d, {}) for n, d in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    first, *others = held
    request = Request(table=first, select=tuple(select), joins=tuple(Join(o, how="cross") for o in others))
    reader = Reader(spark, Names({n.lower(): frozenset(c.lower() for c in t.df.columns) for n, t in held.items()}))
    read = _Read(_items(reader, request.select, held), {o: reader.condition("true") for o in others}, [], [], [], [])
    leaves = _empty(spark, held)
    with _trying():
        found = trace(_build(request, read, leaves), leaves)
    return {n: None if e.nested or o.inside else sorted({c for _, c in o.sources}) for (n, e), o in zip(read.select, found.outputs)}


def output_policy(sources: Mapping[str, str] | None, name: str, declared: Mapping[str, str], bare: bool = True) -> Policy:
    """Class of an output from the classes of its source columns (None: unknown lineage).

    The greatest of these decides: a high-risk source, sources of several classes or a
    computation on what is only shown in part (both unknown), one class, the class of its name.
    """
    if sources is None:
        return Policy(X.UNKNOWN_SENSITIVE, name, True)
    ranked = sorted((c for c, k in sources.items() if k != X.PUBLIC), key=lambda c: sources[c] not in X.HIGH_RISK)
    if not ranked:
        cls = N.declared_class(name, declared)
        return Policy(cls, name, cls != X.PUBLIC)
    lead = sources[ranked[0]]
    mixed = len({sources[c] for c in ranked}) > 1
    shown = lead if lead in X.HIGH_RISK or not mixed and (bare or lead not in GENERALISED) else X.UNKNOWN_SENSITIVE
    return Policy(shown, ranked[0], True)


def guard(request: Request, read: _Read, found: Trace, types: T.StructType, tables: Mapping[str, _Table]) -> None:
    """Refuse a request that uses a protected column, or what comes from one, outside a projection.

    In a projection, functions, CASE, windows, casts and comparisons over a protected column are
    refused as well, and sums and products of whole or decimal numbers, which may overflow: an error
    would tell the value. Outside the projection what is read from inside a value counts as every
    protected column.
    """
    # Names are matched across tables: a name protected in one table is protected in all.
    protected = {c.lower() for t in tables.values() for c, k in t.classes.items() if k != X.PUBLIC}

    def held(origin: Origin) -> set[str]:
        return {c for _, c in origin.sources if c.lower() in protected}

    restricted: set[str] = {c for j in request.joins for c in j.using if c.lower() in protected}
    for origin in found.used:
        restricted |= protected if origin.inside else held(origin)
    outside = [*read.on.values(), *read.where, *read.group_by, *read.having, *(o.value for o in read.order_by)]
    if any(e.nested for e in outside):
        restricted |= protected
    for (_, e), origin, f in zip(read.select, found.outputs, types.fields):
        if e.looks or not e.plain and isinstance(f.dataType, (T.IntegralType, T.DecimalType)):
            restricted |= held(origin)
    if restricted:
        raise RestrictedUse(sorted(restricted, key=str.lower))


def resolve(
    tables: Mapping[str, DataFrame],
    request: Request,
    declared: Mapping[str, str] | None = None,
    most_columns: int | None = MAX_COLUMNS,
) -> tuple[DataFrame, dict[str, Policy]]:
    """(raw rows, policy per output column) of a request that passed the guard."""
    declared = dict(declared or {})
    held = {
        n: _Table(d, {c: N.declared_class(c, declared) for c in d.columns}) for n, d in tables.items()
    }
    return _resolve(held, request, declared, most_columns)


def _resolve(held: dict[str, _Table], request: Request, declared: Mapping[str, str], most_columns: int | None):
    held = dict(held)
    for name, inner in request.ctes.items():
        df, policies = _resolve(held, inner, declared, most_columns)
        held[name] = _Table(df, {c: p.cls for c, p in policies.items()})
    used = {n: held[n] for n in [request.table, *[j.table for j in request.joins]]}
    spark = held[request.table].df.sparkSession
    read = _read(spark, request, used)
    if most_columns is not None and len(read.select) > most_columns:
        raise ValueError(f"a result has at most {most_columns} columns")
    leaves = _empty(spark, used)
    with _trying():
        shape = _build(request, read, leaves)
        found = trace(shape, leaves)
        types = shape.schema
    guard(request, read, found, types, used)
    policies: dict[str, Policy] = {}
    for (name, e), origin in zip(read.select, found.outputs):
        sources = None if e.nested or origin.inside else {c: used[t].classes[c] for t, c in sorted(origin.sources)}
        policies[name] = output_policy(sources, name, declared, bool(e.plain))
    with _trying():
        df = _build(request, read, {n: t.df for n, t in used.items()})
    for other in request.union_all:
        more, theirs = _resolve(held, other, declared, most_columns)
        if len(theirs) != len(policies):
            raise ValueError("all parts of a union have the same number of columns")
        with _trying():
            df = df.union(more)
        # One strategy per output: parts that disagree are redacted.
        policies = {
            n: a if a.cls == b.cls else Policy(X.UNKNOWN_SENSITIVE, a.source, True)
            for (n, a), b in zip(policies.items(), theirs.values())
        }
    return df, policies


def mask(df: DataFrame, policies: Mapping[str, Policy], key: Key, declared: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with every output treated as its policy says."""
    settled = {n: (p.cls, p.source) for n, p in policies.items()}
    return protect(df, declared, key, settled=settled)


def shaped(df: DataFrame, mode: str) -> DataFrame:
    """Cells as shown: binary as a size; in short mode long and structured text as placeholders."""
    if mode not in ("short", "full"):
        raise ValueError("value_mode is short or full")
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = V.binary_marker(c)
        elif mode == "short" and isinstance(f.dataType, T.StringType):
            c = V.bounded_text(c, f.name)
        out.append(c.alias(f.name, metadata=f.metadata or {}))
    return df.select(*out)


def bound(df: DataFrame, max_rows: int = DEFAULT_ROWS, max_bytes: int = MAX_BYTES, most_rows: int | None = MAX_ROWS) -> DataFrame:
    """First rows within a row and a byte limit, with ``row_number``, ``running_bytes`` and the
    reason when the answer is cut.

    ``limit`` ends the distributed part: the running total only ever sees ``max_rows + 1`` rows.
    """
    _check_rows(max_rows, most_rows)
    cells = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(4)) for c in df.columns]
    size = F.lit(len(df.columns) * 3 + 2)
    for c in cells:
        size = size + c
    few = df.limit(max_rows + 1).withColumn("__n", F.monotonically_increasing_id())
    order = Window.orderBy("__n")
    few = few.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.row_number().over(order).alias("row_number"),
        F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("running_bytes"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("__total"),
        F.sum(size).over(Window.partitionBy()).alias("__bytes"),
    )
    reason = F.when(F.col("__bytes") > max_bytes, "output_limit").when(F.col("__total") > max_rows, "row_limit")
    kept = few.withColumn("truncation_reason", reason)
    kept = kept.where((F.col("row_number") <= max_rows) & (F.col("running_bytes") <= max_bytes))
    return kept.drop("__total", "__bytes")


def _check_rows(max_rows: int, most_rows: int | None) -> None:
    if max_rows < 1 or most_rows is not None and max_rows > most_rows:
        raise ValueError(f"max_rows lies between 1 and {most_rows}")


def protected_select(
    tables: Mapping[str, DataFrame],
    request: Request,
    key: Key,
    declared: Mapping[str, str] | None = None,
    max_bytes: int = MAX_BYTES,
    most_rows: int | None = MAX_ROWS,
    most_columns: int | None = MAX_COLUMNS,
) -> DataFrame:
    """Bounded, masked answer to a request."""
    _check_rows(request.max_rows, most_rows)
    df, policies = resolve(tables, request, declared, most_columns)
    # Bounding before masking keeps the keyed work to the rows that are returned.
    masked = mask(df.limit(request.max_rows + 1), policies, key, declared)
    return bound(shaped(masked, request.value_mode), request.max_rows, max_bytes, most_rows)


def protected_rows(
    tables: Mapping[str, DataFrame], request: Request, key: Key, declared: Mapping[str, str] | None = None
) -> DataFrame:
    """Masked answer without bounds, for distributed consumers."""
    df, policies = resolve(tables, request, declared)
    return mask(df, policies, key, declared)


def protected_write(
    tables: Mapping[str, DataFrame],
    request: Request,
    key: Key,
    path: str,
    declared: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """Write the whole masked answer."""
    protected_rows(tables, request, key, declared).write.format(fmt).mode(mode).save(path)
