"""Protection of whole tables: dispatch per column, decisions, counts and markers.

The class of every column is settled while the plan is built, from its name and its declared
label, so a public number stays a bare column reference. Only public and free-text strings are
looked at value by value. Protection never shuffles: it is a chain of projections.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableguard.functions import fixed as X, keyed as K, names as N, scan as S, values as V
from tableguard.functions.keyed import Key

DIGIT_CLASSES = (X.PHONE, X.FINANCIAL_ACCOUNT, X.CREDIT_CARD)
_HELD = (X.PUBLIC, X.FREE_TEXT)


def field_labels(schema: T.StructType) -> dict[str, str]:
    """Classes declared in column metadata (``information_type``, ``label``)."""
    out = {}
    for f in schema.fields:
        m = f.metadata or {}
        if m.get("information_type") or m.get("label"):
            out[f.name] = N.label_class(m.get("information_type"), m.get("label"))
    return out


def declared_labels(labels: DataFrame) -> DataFrame:
    """(table_name, column_name, class) from label rows; the most restrictive label wins.

    ``labels`` has ``table_name, column_name, information_type, label``.
    """
    order = ["public", "scan", "generalize", "alias", "fake", "redact"]
    cls = N.classify_label("information_type", "label")
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), N.treatment(F.col("class")))
    return (
        labels.select(
            "table_name", F.lower("column_name").alias("column_name"), cls.alias("class")
        )
        .where(F.col("class") != X.PUBLIC)
        .groupBy("table_name", "column_name")
        .agg(F.max(F.struct(rank.alias("rank"), F.col("class"))).alias("top"))
        .select("table_name", "column_name", F.col("top.class").alias("class"))
    )


def column_classes(columns: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Class and treatment of every row of a column list (``table_name, column_name``)."""
    if labels is None:
        known = columns.withColumn("declared", F.lit(None).cast("string"))
    else:
        d = declared_labels(labels).select(
            F.col("table_name").alias("dt"), F.col("column_name").alias("dc"), F.col("class").alias("declared")
        )
        same = (columns["table_name"] == F.col("dt")) & (F.lower(columns["column_name"]) == F.col("dc"))
        known = columns.join(d, same, "left").drop("dt", "dc")
    cls = N.column_class("column_name", "declared")
    return known.withColumn("class", cls).withColumn("treatment", N.treatment(F.col("class")))


# Plan-time description of one leaf value -------------------------------------------------


@dataclass
class _Cell:
    name: str
    col: Column
    dtype: T.DataType
    cls: str
    number: int
    staged: dict[str, Column] = field(default_factory=dict)

    def temp(self, kind: str) -> str:
        return f"__tg_{kind}{self.number}"

    @property
    def held(self) -> bool:
        return self.cls in _HELD

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, (T.StringType, T.VarcharType, T.CharType))


def _has_protected_leaf(dtype: T.DataType, name: str, declared: Mapping[str, str]) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_protected_leaf(f.dataType, f.name, declared) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_protected_leaf(dtype.elementType, name, declared)
    if isinstance(dtype, T.MapType):
        return True  # keys are only known at run time
    return isinstance(dtype, T.StringType) or N.declared_class(name, declared) not in _HELD


def _masked_type(dtype: T.DataType, name: str, declared: Mapping[str, str]) -> T.DataType:
    """Type of a nested value after its leaves were protected."""
    if N.declared_class(name, declared) in X.HIGH_RISK:
        return T.StringType()
    if isinstance(dtype, T.StructType):
        return T.StructType(
            [T.StructField(f.name, _masked_type(f.dataType, f.name, declared)) for f in dtype.fields]
        )
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_masked_type(dtype.elementType, name, declared))
    if isinstance(dtype, T.MapType):
        return T.MapType(T.StringType(), T.StringType())
    return dtype if N.declared_class(name, declared) in _HELD else T.StringType()


class _Plan:
    """Leaves of a schema and the expression that rebuilds each column from them."""

    def __init__(
        self,
        df: DataFrame,
        declared: Mapping[str, str],
        key: Key,
        scan_public: bool,
        settled: Mapping[str, tuple[str, str]] | None = None,
    ) -> None:
        self.declared, self.key, self.scan_public = dict(declared), key, scan_public
        self.settled = dict(settled or {})
        self.cells: list[_Cell] = []
        self.outputs = [
            (f.name, self._node(f.name, F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields
        ]

    def _node(self, name: str, col: Column, dtype: T.DataType, inner: bool = False):
        cls, name = (not inner and self.settled.get(name)) or (
            N.declared_class(name, self.declared),
            name,
        )
        nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
        if nested and cls not in X.HIGH_RISK:
            if not _has_protected_leaf(dtype, name, self.declared):
                return lambda: col
            if isinstance(dtype, T.StructType):
                parts = [(f.name, self._node(f.name, col[f.name], f.dataType, True)) for f in dtype.fields]
                return lambda: F.when(
                    col.isNotNull(), F.struct(*[build().alias(n) for n, build in parts])
                )
            # Elements of arrays and maps go through JSON, where the walker handles each one.
            out = _masked_type(dtype, name, self.declared)
            masked = S.protect_json(F.to_json(col), name, self.key, self.declared)
            return lambda: F.from_json(masked, out)
        cell = _Cell(name, col, dtype, cls, len(self.cells))
        self.cells.append(cell)
        return lambda: self.value(cell)

    def _looked_at(self, cell: _Cell) -> bool:
        return cell.held and cell.is_text

    def _digit_like(self, c: _Cell) -> bool:
        return c.cls in DIGIT_CLASSES + (X.NATIONAL_ID,) or (self._looked_at(c) and c.cls == X.PUBLIC)

    def stage(self, df: DataFrame) -> DataFrame:
        """Add the parts of every fake as columns, step by step.

        Each part is referenced several times by the next one, so it is computed once and the
        generated code stays small.
        """
        public = [c for c in self.cells if self._looked_at(c) and c.cls == X.PUBLIC]
        keyed = [
            c
            for c in self.cells
            if not c.held and X.TREATMENT.get(c.cls) in ("fake", "alias") and c.dtype != T.BinaryType()
        ]
        first = [V.classify_value(c.col).alias(c.temp("c")) for c in public]
        first += [V.as_text(c.col, c.dtype).alias(c.temp("x")) for c in keyed]
        if first:
            df = df.select("*", *first)
        names = [c for c in keyed if c.cls == X.PERSONAL_NAME]
        if names:
            df = df.select("*", *[K.name_source(F.col(c.temp("x"))).alias(c.temp("m")) for c in names])
        digests = []
        for c in names:
            for salt in ("given", "family"):
                made = K.name_digest(salt, F.col(c.temp("m"))["text"], self.key)
                digests.append(made.alias(c.temp(salt)))
        for c in public:
            cls = F.col(c.temp("c"))
            used = cls.isin(X.EMAIL, X.NATIONAL_ID, X.PHONE, X.CREDIT_CARD)
            digests.append(F.when(used, K.keyed_digest(cls, c.col, self.key)).alias(c.temp("h")))
        for c in keyed:
            if c.cls != X.PERSONAL_NAME:
                digests.append(K.keyed_digest(c.cls, F.col(c.temp("x")), self.key).alias(c.temp("h")))
        if digests:
            df = df.select("*", *digests)
        numbers = [c for c in public + keyed if self._digit_like(c)]
        if numbers:
            limbs, parts = [], []
            for c in numbers:
                named = [(sql, f"{c.temp('l')}_{i}") for i, sql in enumerate(K.digest_limbs(c.temp("h")))]
                limbs += [F.expr(sql).alias(name) for sql, name in named]
                parts.append(K.limb_digits([name for _, name in named]).alias(c.temp("d")))
                known = F.col(c.temp("h")).isNotNull()
                parts.append(F.when(known, K.digit_count(self._text(c))).alias(c.temp("n")))
            df = df.select("*", *limbs).select("*", *parts)
            fresh = []
            for c in numbers:
                d, n = (F.col(c.temp(k)) for k in "dn")
                one = K.fresh_digits(d, n)
                national = (F.col(c.temp("c")) if c.cls == X.PUBLIC else F.lit(c.cls)) == X.NATIONAL_ID
                if c.cls in (X.PUBLIC, X.NATIONAL_ID):
                    one = F.when(national & (n == 13), K.fresh_thai_id(d)).otherwise(one)
                fresh.append(one.alias(c.temp("f")))
            df = df.select("*", *fresh)
            # Only long values need lists, in a projection of its own.
            long = [K.long_fake(self._text(c), F.col(c.temp("h")), F.col(c.temp("n"))).alias(c.temp("w")) for c in numbers if self._may_be_long(c)]
            df = df.select("*", *long) if long else df
        loose = []
        for c in self.cells:
            if self._looked_at(c) and (self.scan_public or c.cls == X.FREE_TEXT):
                wanted = None
                if c.cls == X.PUBLIC:
                    wanted = F.col(c.temp("c")).isin(X.PUBLIC, X.PERSONAL_NAME)
                j, t = S.protect_loose(c.col, c.name, self.key, self.declared, wanted)
                loose += [j.alias(c.temp("j")), t.alias(c.temp("t"))]
        return df.select("*", *loose) if loose else df

    def _text(self, c: _Cell) -> Column:
        return c.col if self._looked_at(c) else F.col(c.temp("x"))

    def _may_be_long(self, c: _Cell) -> bool:
        """Whether a value may have more than 19 digits. Whole numbers of 64 bits have no more, and
        doubles 17 and three of the exponent."""
        return not isinstance(c.dtype, (T.IntegralType, T.FloatType, T.DateType, T.BooleanType))

    def _number(self, c: _Cell) -> Column:
        long = F.col(c.temp("w")) if self._may_be_long(c) else None
        return K.write_digits(self._text(c), F.col(c.temp("f")), F.col(c.temp("n")), long)

    def value(self, c: _Cell) -> Column:
        if self._looked_at(c):
            return self._text_value(c)
        if c.cls == X.PUBLIC or (c.cls == X.FREE_TEXT and not c.is_text):
            if isinstance(c.dtype, T.BinaryType) and c.cls != X.PUBLIC:
                return V.redact(c.col)
            return c.col
        if c.cls in X.HIGH_RISK or isinstance(c.dtype, T.BinaryType):
            return V.redact(c.col)
        h = F.col(c.temp("h"))
        if c.cls == X.PERSONAL_NAME:
            parts = [F.col(c.temp(k)) for k in ("m", "given", "family")]
            return F.when(F.col(c.temp("x")).isNotNull(), K.render_name(K.name_parts(c.name), *parts))
        if self._digit_like(c):
            return self._number(c)
        if c.cls == X.EMAIL:
            return K.alias(h, X.EMAIL_SUFFIX)
        if c.cls == X.USERNAME:
            return K.alias(h)
        if c.cls == X.DATE_OF_BIRTH:
            return V.birth_year(c.col, c.dtype)
        if c.cls == X.PRECISE_LOCATION:
            return V.coarse_location(c.col)
        return V.mask_address(c.col)

    def _text_value(self, c: _Cell) -> Column:
        scanned = self.scan_public or c.cls == X.FREE_TEXT
        j = F.col(c.temp("j")) if scanned else F.lit(None).cast("string")
        t = F.col(c.temp("t")) if scanned else F.lit(None).cast("string")
        if c.cls == X.FREE_TEXT:
            return F.coalesce(j, t, c.col)
        cls, h = F.col(c.temp("c")), F.col(c.temp("h"))
        name = V.stripped(t) if scanned else F.lit(X.REDACTED)
        return (
            F.when(j.isNotNull(), j)
            .when(cls == X.PUBLIC, F.coalesce(t, c.col))
            .when(cls == "jwt", X.REDACTED)
            .when(cls == X.EMAIL, K.alias(h, X.EMAIL_SUFFIX))
            .when(cls == X.PERSONAL_NAME, name)
            .otherwise(self._number(c))
        )


def protect(
    df: DataFrame,
    policy: Mapping[str, str] | None,
    key: Key,
    *,
    scan_public: bool = True,
    settled: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """The table with every sensitive value faked, aliased, generalised, scanned or redacted.

    ``policy`` maps column names to declared classes and adds to the labels found in column
    metadata and to the name rules. Protected columns become strings; column metadata carries
    their marker. ``scan_public=False`` leaves embedded personal data in public strings alone and
    keeps the whole job in the JVM, for tables whose profile shows there is none. ``settled`` maps
    a column to a (class, source name) that was decided elsewhere and is not questioned here.
    """
    declared = {**field_labels(df.schema), **(policy or {})}
    plan = _Plan(df, declared, key, scan_public, settled)
    staged = plan.stage(df)
    out = []
    for name, build in plan.outputs:
        mark = N.marker(plan.settled[name][0] if name in plan.settled else N.declared_class(name, declared))
        meta = {"marker": mark} if mark else {}
        out.append(build().alias(name, metadata=meta))
    return staged.select(*out)


def markers(df: DataFrame, policy: Mapping[str, str] | None, key: Key) -> DataFrame:
    """(column_name, marker) of every protected column.

    A public string column is marked as scanned when any of its values changed; that takes one
    aggregate over the table, with one row per task leaving the map side.
    """
    declared = {**field_labels(df.schema), **(policy or {})}
    fixed = {f.name: N.marker(N.declared_class(f.name, declared)) for f in df.schema.fields}
    checked = [
        f.name for f in df.schema.fields if not fixed[f.name] and isinstance(f.dataType, T.StringType)
    ]
    known = [
        F.struct(F.lit(n).alias("column_name"), F.lit(m).alias("marker"))
        for n, m in fixed.items()
        if m
    ]
    plan = _Plan(df.select(*[F.col(f"`{c}`") for c in checked]), declared, key, True)
    after = {name: build() for name, build in plan.outputs}
    same = {c: F.col(f"`{c}`").eqNullSafe(after[c]) for c in checked}
    changed = plan.stage(df.select(*[F.col(f"`{c}`") for c in checked])).agg(
        F.lit(1).alias("__tg_one"), *[F.bool_or(~same[c]).alias(c) for c in checked]
    )
    scanned = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.when(F.col(f"`{c}`"), F.lit(X.SCANNED_MARKER)).alias("marker"),
        )
        for c in checked
    ]
    return changed.select(F.inline(F.array(*known, *scanned))).where("marker is not null")


def with_markers(df: DataFrame, marks: Mapping[str, str]) -> DataFrame:
    """Columns renamed to ``name marker`` for sinks that have no column metadata."""
    return df.select(
        *[F.col(f"`{c}`").alias(f"{c} {marks[c]}" if marks.get(c) else c) for c in df.columns]
    )


def explain_masking(
    df: DataFrame,
    column: str,
    policy: Mapping[str, str] | None,
    key: Key,
    override: Column | None = None,
) -> DataFrame:
    """The table plus a ``decision`` struct for one column: class, action, rule, masked value."""
    declared = {**field_labels(df.schema), **(policy or {})}
    raw = F.col(f"`{column}`")
    by_rule = V.classify(N.declared_class(column, declared), raw.cast("string"))
    cls = by_rule if override is None else F.coalesce(override, by_rule)
    kept = df.select("*", cls.alias("__tg_cls"))
    branches = None
    text = raw.cast("string")
    h = K.keyed_digest(F.col("__tg_cls"), text, key)
    number = K.write_digits(text, F.col("__tg_f"), F.col("__tg_n"), F.col("__tg_w"))
    part = {
        X.PERSONAL_NAME: K.fake_name(column, text, key),
        X.NATIONAL_ID: number,
        X.EMAIL: K.alias(F.col("__tg_h"), X.EMAIL_SUFFIX),
        X.USERNAME: K.alias(F.col("__tg_h")),
        X.DATE_OF_BIRTH: V.birth_year(raw, df.schema[column].dataType),
        X.PRECISE_LOCATION: V.coarse_location(raw),
        X.ADDRESS: V.mask_address(raw),
        X.FREE_TEXT: F.col("__tg_scan"),
        X.PUBLIC: F.col("__tg_scan"),
    }
    for c in DIGIT_CLASSES:
        part[c] = number
    j, t = S.protect_loose(text, column, key, declared)
    kept = kept.select("*", h.alias("__tg_h"), F.coalesce(j, t, text).alias("__tg_scan"))
    kept = kept.select(
        "*", K.digest_digits("__tg_h").alias("__tg_d"), K.digit_count(text).alias("__tg_n")
    )
    dc, nc = F.col("__tg_d"), F.col("__tg_n")
    thai = (F.col("__tg_cls") == X.NATIONAL_ID) & (nc == 13)
    fresh = F.when(thai, K.fresh_thai_id(dc)).otherwise(K.fresh_digits(dc, nc))
    kept = kept.select("*", fresh.alias("__tg_f"), K.long_fake(text, F.col("__tg_h"), nc).alias("__tg_w"))
    for c, expr in part.items():
        test = F.col("__tg_cls") == c
        branches = F.when(test, expr) if branches is None else branches.when(test, expr)
    value = F.when(text.isNotNull(), branches.otherwise(X.REDACTED))
    kept = kept.select("*", value.alias("__tg_masked"))
    same = F.col("__tg_masked").eqNullSafe(text)
    loose = F.col("__tg_cls") == X.PUBLIC
    treat = F.when(F.col("__tg_masked") == X.REDACTED, "redact").otherwise(N.treatment(F.col("__tg_cls")))
    action = (
        F.when(text.isNull(), "keep")
        .when(loose, F.when(same, "keep").otherwise("scan"))
        .otherwise(treat)
    )
    rule = (
        F.when(text.isNull() | (loose & same), "public")
        .when(loose | (treat == "scan"), "embedded-pii-scan")
        .when((treat == "redact") & F.col("__tg_cls").isin(X.HIGH_RISK), "high-risk-secret")
        .when(treat == "redact", "fail-closed")
        .when(treat == "fake", "snapshot-hmac-fake")
        .when(treat == "alias", "snapshot-hmac")
        .otherwise("strict-generalization")
    )
    decision = F.struct(
        F.col("__tg_cls").alias("class"),
        action.alias("action"),
        rule.alias("rule"),
        F.col("__tg_masked").alias("masked_value"),
    )
    return kept.select(*[F.col(f"`{c}`") for c in df.columns], decision.alias("decision"))


def _leaves(name: str, col: Column, dtype: T.DataType, declared: Mapping[str, str]):
    """(name, column, type, class) of what protection treats by itself inside a column."""
    cls = N.declared_class(name, declared)
    if isinstance(dtype, T.StructType) and cls not in X.HIGH_RISK:
        for f in dtype.fields:
            yield from _leaves(f.name, col[f.name], f.dataType, declared)
    elif isinstance(dtype, (T.ArrayType, T.MapType)) and cls not in X.HIGH_RISK:
        if _has_protected_leaf(dtype, name, declared):
            yield name, col, dtype, X.PUBLIC
    else:
        yield name, col, dtype, cls


def treatment_counts(df: DataFrame, policy: Mapping[str, str] | None, key: Key) -> DataFrame:
    """(treatment, n): how many values each treatment replaces in the whole table.

    Fields of structs count as columns do; elements of arrays and maps are counted as JSON.
    """
    declared = {**field_labels(df.schema), **(policy or {})}
    staged, sums = [], {t: [] for t in S.COUNTED}
    leaves = [x for f in df.schema.fields for x in _leaves(f.name, F.col(f"`{f.name}`"), f.dataType, declared)]
    for i, (name, c, dtype, cls) in enumerate(leaves):
        if cls not in _HELD:
            sums[X.TREATMENT.get(cls, "redact")].append(c.isNotNull().cast("long"))
        elif isinstance(dtype, (T.ArrayType, T.MapType)):
            staged.append(S.loose_counts(F.to_json(c), name, key, declared).alias(f"__tg_n{i}"))
            for t in S.COUNTED:
                sums[t].append(F.coalesce(F.col(f"__tg_n{i}.{t}"), F.lit(0)))
        elif isinstance(dtype, T.StringType):
            shape = V.classify_value(c) if cls == X.PUBLIC else F.lit(X.PUBLIC)
            staged.append(N.treatment(shape).alias(f"__tg_s{i}"))
            staged.append(
                S.loose_counts(F.when(shape == X.PUBLIC, c), name, key, declared).alias(f"__tg_n{i}")
            )
            for t in S.COUNTED:
                whole = (F.col(f"__tg_s{i}") == t).cast("long")
                sums[t].append(whole + F.coalesce(F.col(f"__tg_n{i}.{t}"), F.lit(0)))
    rows = df.select("*", *staged)
    none = F.lit(0).cast("long")
    totals = rows.agg(
        *[F.coalesce(F.sum(sum(parts, none)), none).alias(t) for t, parts in sums.items()]
    )
    pairs = F.array(*[F.struct(F.lit(t).alias("treatment"), F.col(t).alias("n")) for t in S.COUNTED])
    return totals.select(F.inline(pairs)).where("n > 0")


def profile_sensitivity(
    df: DataFrame, *, cast_numbers: bool = False, distinct_share: bool = False
) -> DataFrame:
    """(column_name, class, n) of value classes over the whole table.

    One pass: every row yields one (column, class) pair per string column and the pairs are
    counted on the map side first. ``distinct_share`` adds an approximate distinct count.
    """
    atoms = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    cols = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) or (cast_numbers and not isinstance(f.dataType, atoms))
    ]
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                V.classify_value(F.col(f"`{c}`").cast("string")).alias("class"),
                (F.col(f"`{c}`").cast("string") if distinct_share else F.lit(None).cast("string")).alias("v"),
                F.col(f"`{c}`").isNull().alias("is_null"),
            )
            for c in cols
        ]
    )
    cells = df.select(F.inline(pairs)).where("not is_null")
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct_share:
        aggs.append(F.approx_count_distinct("v").alias("distinct_values"))
    return cells.groupBy("column_name", "class").agg(*aggs)


def protect_distinct(df: DataFrame, column: str, policy: Mapping[str, str], key: Key, salts: int = 16) -> DataFrame:
    """Mask one column through its distinct values and join them back.

    Pays off when the distinct share is small. The distinct values are found with a map-side
    aggregate. The few rows of the mapping are repeated ``salts`` times, and each partition of the
    big side meets one of the copies, so a hot value, and null, spread over as many tasks.
    """
    values = df.select(F.col(f"`{column}`").alias(column)).where(F.col(f"`{column}`").isNotNull()).distinct()
    plan = _Plan(values, {**field_labels(df.schema), **policy}, key, False)
    mapped = plan.stage(values).select(
        F.col(f"`{column}`").alias("__tg_from"), plan.outputs[0][1]().alias("__tg_to")
    )
    copies = mapped.withColumn("__tg_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("__tg_own", F.pmod(F.spark_partition_id(), F.lit(salts)))
    same = (F.col(f"`{column}`") == F.col("__tg_from")) & (F.col("__tg_own") == F.col("__tg_salt"))
    joined = salted.join(copies, same, "left")
    return joined.select(
        *[F.col("__tg_to").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    )
