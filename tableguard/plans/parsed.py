"""Request texts as Spark's own parser reads them.

A text is parsed once, by the session's parser. What is checked is the tree, and the column that
runs is made from the same tree, so nothing can be read in one way and run in another: comments,
raw and quoted literals, escapes and backticks are settled before anything is decided. Trees are held
to kinds of nodes that are known to be harmless; any other kind is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import Column, SparkSession
from pyspark.sql.classic.column import Column as ClassicColumn

from tableguard.functions.allowed import ALLOWED

# Spark's own spellings of allowed functions, and the functions behind BETWEEN and EXTRACT.
_SPARK_NAMES = frozenset("get_json_object to_json named_struct struct date_format date_part if between extract locate".split())
#: Kinds of nodes that combine values without telling one from the other.
_COMBINING = frozenset("Literal UnresolvedAttribute Concat Add Subtract Multiply UnaryMinus UnaryPositive".split())
#: Kinds that look into values: over protected columns they would let them be inferred.
_LOOKING = frozenset("""
    UnresolvedFunction CaseWhen If Cast Divide Remainder IntegralDivide
    EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual And Or Not IsNull IsNotNull In
    Like ILike RLike LikeAny LikeAll NotLikeAny NotLikeAll BitwiseAnd BitwiseOr BitwiseXor BitwiseNot
    Substring StringLocate StringTrim StringTrimLeft StringTrimRight TimestampAdd TimestampDiff
    WindowExpression CreateNamedStruct UnresolvedExtractValue SemiStructuredExtract
""".split())  # fmt: skip
#: Parts of the kinds above.
_PARTS = frozenset("""
    WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ RowFrame$ RangeFrame$ CurrentRow$ UnboundedPreceding$
    UnboundedFollowing$ SortOrder NamePlaceholder$
""".split())  # fmt: skip
_NESTED = frozenset("UnresolvedExtractValue SemiStructuredExtract".split())
#: Names without a bracket that are values of the moment, and those that tell of the session.
_MOMENTS = frozenset("current_date current_timestamp current_time localtimestamp".split())
_SESSION = frozenset("current_user session_user user current_catalog current_database current_schema".split())


class RefusedExpression(ValueError):
    """An expression holds what a request may not hold."""


def items(sequence: JavaObject) -> Iterator[JavaObject]:
    """Elements of a Scala collection."""
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def nodes(tree: JavaObject) -> Iterator[JavaObject]:
    """The node and all below it."""
    yield tree
    for child in items(tree.children()):
        yield from nodes(child)


@dataclass(frozen=True)
class Names:
    """Columns that a text may name: by table in lower case, and outputs of the request."""

    tables: dict[str, frozenset[str]]
    outputs: frozenset[str] = frozenset()

    def holds(self, column: str) -> bool:
        return column in self.outputs or any(column in c for c in self.tables.values())


@dataclass(frozen=True)
class Parsed:
    """A checked expression."""

    text: str
    tree: JavaObject
    name: str | None = None
    plain: tuple[str, ...] = ()  # its name parts, if it is a bare column
    looks: bool = False  # looks into values by a function, CASE, window, cast or comparison
    nested: bool = False  # reads inside a value, so that columns do not tell what comes out
    literal: bool = False

    def column(self, spark: SparkSession) -> Column:
        return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(self.tree))

    def same(self, other: Parsed) -> bool:
        return bool(self.tree.equals(other.tree))


@dataclass(frozen=True)
class Ordered:
    value: Parsed
    descending: bool
    nulls_first: bool

    def directed(self, c: Column) -> Column:
        if self.nulls_first:
            return c.desc_nulls_first() if self.descending else c.asc_nulls_first()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


class Reader:
    """Parses and checks the texts of one request."""

    def __init__(self, spark: SparkSession, names: Names) -> None:
        self.spark, self.names = spark, names
        self._parser = spark._jsparkSession.sessionState().sqlParser()

    def star(self, text: str) -> tuple[str, ...] | None:
        """Name of the table whose columns a star stands for (empty: all); None if it is no star."""
        tree = self._parse(text)
        if kind(tree) != "UnresolvedStar":
            return None
        target = tree.target()
        return tuple(items(target.get())) if target.isDefined() else ()

    def value(self, text: str, outputs: frozenset[str] = frozenset()) -> Parsed:
        """An expression, with its alias if it has one. ``outputs``: aliases it may name."""
        tree, name = self._parse(text), None
        while kind(tree) == "Alias":
            name, tree = name or tree.name(), tree.child()
        return self._checked(text, tree, name, outputs)

    def condition(self, text: str, outputs: frozenset[str] = frozenset()) -> Parsed:
        parsed = self.value(text, outputs)
        if parsed.name is not None and not parsed.nested:
            raise RefusedExpression(f"an alias has no place here: {text}")
        return parsed

    def key(self, text: str) -> Parsed:
        """An expression to group by. A number would be a place in the output, and is refused."""
        return self._not_a_place(self.condition(text))

    def order(self, text: str, outputs: frozenset[str] = frozenset()) -> Ordered:
        """An expression to sort by, with its direction."""
        try:
            plan = self._parser.parsePlan(f"select 1 order by {text}\n")
        except ParseException as error:
            raise RefusedExpression(f"not an expression to sort by: {text}") from error
        orders = list(items(plan.order())) if kind(plan) == "Sort" else []
        if len(orders) != 1 or kind(plan.child()) != "Project" or kind(plan.child().child()) != "OneRowRelation" or kind(orders[0]) != "SortOrder":
            raise RefusedExpression(f"not an expression to sort by: {text}")
        order = orders[0]
        value = self._not_a_place(self._checked(text, order.child(), None, outputs))
        return Ordered(value, order.direction().sql() == "DESC", order.nullOrdering().sql() == "NULLS FIRST")

    def column_of(self, table: str, column: str) -> Parsed:
        quoted = ".".join("`" + part.replace("`", "``") + "`" for part in (table, column))
        return self._checked(quoted, self._parse(quoted), column, frozenset())

    def _parse(self, text: str) -> JavaObject:
        try:
            return self._parser.parseExpression(text)
        except ParseException as error:
            raise RefusedExpression(f"not an expression: {text}") from error

    @staticmethod
    def _not_a_place(parsed: Parsed) -> Parsed:
        if parsed.literal:
            raise RefusedExpression(f"a constant is no expression to sort or group by: {parsed.text}")
        return parsed

    def _checked(self, text: str, tree: JavaObject, name: str | None, outputs: frozenset[str]) -> Parsed:
        looks = nested = False
        plain: tuple[str, ...] = ()
        for node in nodes(tree):
            k = kind(node)
            if k in ("UnresolvedStar", "UnresolvedStarExceptOrReplace"):
                raise RefusedExpression("a star stands alone or in count(*)")
            if k not in _COMBINING and k not in _LOOKING and k not in _PARTS:
                raise RefusedExpression("a subquery belongs into ctes" if "Subquery" in k or k in ("Exists", "ListQuery") else f"{k} is not allowed")
            looks |= k in _LOOKING
            nested |= k in _NESTED
            if k == "UnresolvedAttribute":
                parts = tuple(items(node.nameParts()))
                nested |= self._known(parts, outputs, text)
                if node.equals(tree):
                    plain = parts
            elif k == "UnresolvedFunction":
                nested |= self._allowed(tuple(items(node.nameParts())))
        return Parsed(text, tree, name, plain, looks, nested, kind(tree) == "Literal")

    def _known(self, parts: tuple[str, ...], outputs: frozenset[str], text: str) -> bool:
        """Whether a name reaches inside a column; names of anything but columns are refused."""
        low = [p.lower() for p in parts]
        if low[0] in self.names.tables and len(low) > 1 and low[1] in self.names.tables[low[0]]:
            return len(low) > 2
        if self.names.holds(low[0]) or low[0] in outputs:
            return len(low) > 1
        if len(low) == 1 and low[0] in _MOMENTS:
            return False
        if low[0] in self.names.tables and len(low) == 1:
            raise RefusedExpression("a table's name is not a value")
        if low[0] in _SESSION:
            raise RefusedExpression(f"function {parts[0]} is not on the allow list")
        raise ValueError(f"expression does not resolve: {text}")

    @staticmethod
    def _allowed(parts: tuple[str, ...]) -> bool:
        """Whether an allowed function reads inside a value."""
        low = parts[-1].lower()
        if len(parts) > 1 or low not in ALLOWED and low not in _SPARK_NAMES:
            raise RefusedExpression(f"function {'.'.join(parts)} is not on the allow list")
        return "json" in low
