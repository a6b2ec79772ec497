"""Expressions over columns, which become Spark columns or SQL text.

Both follow one set of rules: NULLs sort last; concat skips NULLs; x / 0 is infinite or NaN; LIKE has no escape character; an empty IN is
false; startswith, endswith and contains take their argument literally.
"""

from __future__ import annotations

import datetime
import decimal
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from tessera.errors import PlanError
from tessera.functions.dialects import Dialect, get_dialect

#: An escape character that no pattern holds.
_NO_ESCAPE = "\x01"
#: Names of types in other databases that Spark has under another name.
_TYPES = {"varchar": "string", "text": "string", "char": "string", "double precision": "double", "float8": "double", "float64": "double", "real": "float", "float4": "float", "int64": "bigint", "int8": "bigint", "int4": "int", "int32": "int", "integer": "int", "int2": "smallint", "int16": "smallint", "hugeint": "decimal(38,0)", "bool": "boolean", "numeric": "decimal(38,18)", "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "bytea": "binary", "blob": "binary"}

AGGREGATES = {"SUM", "AVG", "MIN", "MAX", "COUNT"}


class Expression:
    """Base of all expressions; operators build new ones."""

    def column(self) -> SparkColumn:
        """The Spark column."""
        raise NotImplementedError

    def to_sql(self, dialect: str | Dialect = "duckdb") -> str:
        """The text in a dialect; an alias is only written by the clause that may have one."""
        return self._sql(dialect if isinstance(dialect, Dialect) else get_dialect(dialect))

    def _sql(self, d: Dialect) -> str:
        raise NotImplementedError

    @property
    def name(self) -> str | None:
        """The name of the result, if the expression says one."""
        return None

    def parts(self) -> Sequence[Expression]:
        return ()

    def has_aggregate(self) -> bool:
        return any(p.has_aggregate() for p in self.parts())

    # operators
    def __eq__(self, other: Any) -> Expression:  # type: ignore[override]
        return Binary("=", self, wrap(other))

    def __ne__(self, other: Any) -> Expression:  # type: ignore[override]
        return Binary("<>", self, wrap(other))

    def __lt__(self, other: Any) -> Expression:
        return Binary("<", self, wrap(other))

    def __le__(self, other: Any) -> Expression:
        return Binary("<=", self, wrap(other))

    def __gt__(self, other: Any) -> Expression:
        return Binary(">", self, wrap(other))

    def __ge__(self, other: Any) -> Expression:
        return Binary(">=", self, wrap(other))

    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise PlanError("an expression has no truth value: combine with & | ~ and put comparisons in parentheses")

    def __add__(self, other: Any) -> Expression:
        return Binary("+", self, wrap(other))

    def __radd__(self, other: Any) -> Expression:
        return Binary("+", wrap(other), self)

    def __sub__(self, other: Any) -> Expression:
        return Binary("-", self, wrap(other))

    def __rsub__(self, other: Any) -> Expression:
        return Binary("-", wrap(other), self)

    def __mul__(self, other: Any) -> Expression:
        return Binary("*", self, wrap(other))

    def __rmul__(self, other: Any) -> Expression:
        return Binary("*", wrap(other), self)

    def __truediv__(self, other: Any) -> Expression:
        return Binary("/", self, wrap(other))

    def __rtruediv__(self, other: Any) -> Expression:
        return Binary("/", wrap(other), self)

    def __and__(self, other: Any) -> Expression:
        return Binary("AND", self, wrap(other))

    def __or__(self, other: Any) -> Expression:
        return Binary("OR", self, wrap(other))

    def __rand__(self, other: Any) -> Expression:
        return Binary("AND", wrap(other), self)

    def __ror__(self, other: Any) -> Expression:
        return Binary("OR", wrap(other), self)

    def __invert__(self) -> Expression:
        return Unary("NOT", self)

    # methods
    def alias(self, name: str) -> Expression:
        return Alias(self, name)

    def is_null(self) -> Expression:
        return Unary("IS NULL", self)

    def is_not_null(self) -> Expression:
        return Unary("IS NOT NULL", self)

    def like(self, pattern: str) -> Expression:
        return Match("like", self, pattern)

    def ilike(self, pattern: str) -> Expression:
        return Match("ilike", self, pattern)

    def contains(self, text: str) -> Expression:
        return Match("contains", self, text)

    def startswith(self, text: str) -> Expression:
        return Match("startswith", self, text)

    def endswith(self, text: str) -> Expression:
        return Match("endswith", self, text)

    def in_(self, values: Sequence[Any]) -> Expression:
        return In(self, tuple(wrap(v) for v in values))

    def between(self, low: Any, high: Any) -> Expression:
        return Between(self, wrap(low), wrap(high))

    def cast(self, kind: str) -> Expression:
        return Cast(self, kind)

    def upper(self) -> Expression:
        return Call("UPPER", (self,))

    def lower(self) -> Expression:
        return Call("LOWER", (self,))

    def trim(self) -> Expression:
        return Call("TRIM", (self,))

    def date_trunc(self, unit: str) -> Expression:
        return DateTrunc(unit, self)

    def sum(self) -> Expression:
        return Call("SUM", (self,))

    def avg(self) -> Expression:
        return Call("AVG", (self,))

    def min(self) -> Expression:
        return Call("MIN", (self,))

    def max(self) -> Expression:
        return Call("MAX", (self,))

    def count(self) -> Expression:
        return Call("COUNT", (self,))

    def count_distinct(self) -> Expression:
        return Call("COUNT", (self,), distinct=True)

    def asc(self) -> Expression:
        return Order(self, False)

    def desc(self) -> Expression:
        return Order(self, True)


@dataclass(frozen=True, eq=False)
class Col(Expression):
    key: str
    table: str | None = None

    @property
    def name(self) -> str:
        return self.key

    def column(self) -> SparkColumn:
        quoted = "`" + self.key.replace("`", "``") + "`"
        return F.col(f"{self.table}.{quoted}" if self.table else quoted)

    def _sql(self, d: Dialect) -> str:
        return f"{d.ident(self.table)}.{d.ident(self.key)}" if self.table else d.ident(self.key)


@dataclass(frozen=True, eq=False)
class Star(Expression):
    def column(self) -> SparkColumn:
        return F.col("*")

    def _sql(self, d: Dialect) -> str:
        return "*"


@dataclass(frozen=True, eq=False)
class Raw(Expression):
    """Text that is taken as it is, as an expression of Spark SQL and of the target."""

    text: str

    @property
    def name(self) -> str | None:
        return self.text if self.text.isidentifier() else None

    def column(self) -> SparkColumn:
        return F.expr(self.text)

    def _sql(self, d: Dialect) -> str:
        return self.text


@dataclass(frozen=True, eq=False)
class Literal(Expression):
    value: Any

    def column(self) -> SparkColumn:
        return F.lit(self.value)

    def _sql(self, d: Dialect) -> str:
        v = self.value
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float) and not math.isfinite(v):
            word = "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
            return f"CAST('{word}' AS {d.float_type})"
        if isinstance(v, (int, float, decimal.Decimal)):
            return str(v)
        if isinstance(v, datetime.datetime):
            return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
        if isinstance(v, datetime.date):
            return f"DATE '{v.isoformat()}'"
        if isinstance(v, bytes):
            return f"X'{v.hex()}'"
        return "'" + str(v).replace("'", "''") + "'"


@dataclass(frozen=True, eq=False)
class Binary(Expression):
    op: str
    left: Expression
    right: Expression

    def parts(self) -> Sequence[Expression]:
        return self.left, self.right

    def column(self) -> SparkColumn:
        a, b = self.left.column(), self.right.column()
        if self.op == "/":
            x, y = a.cast("double"), b.cast("double")
            by_zero = F.when(x.isNull() | F.isnan(x) | (x == 0), F.when(x.isNotNull(), F.lit(float("nan")))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "AND": lambda: a & b, "OR": lambda: a | b}[self.op]()

    def _sql(self, d: Dialect) -> str:
        a, b = self.left._sql(d), self.right._sql(d)
        if self.op == "/" and not d.divides_by_zero:
            x, y = f"CAST({a} AS {d.float_type})", f"CAST({b} AS {d.float_type})"
            inf, nan = (Literal(float(v))._sql(d) for v in ("inf", "nan"))
            return f"CASE WHEN {y} = 0 THEN CASE WHEN {x} > 0 THEN {inf} WHEN {x} < 0 THEN -{inf} WHEN {x} = 0 THEN {nan} END ELSE {x} / {y} END"
        return f"({a} {self.op} {b})"


@dataclass(frozen=True, eq=False)
class Unary(Expression):
    op: str
    of: Expression

    def parts(self) -> Sequence[Expression]:
        return (self.of,)

    def column(self) -> SparkColumn:
        c = self.of.column()
        return {"NOT": lambda: ~c, "IS NULL": c.isNull, "IS NOT NULL": c.isNotNull}[self.op]()

    def _sql(self, d: Dialect) -> str:
        text = self.of._sql(d)
        return f"(NOT {text})" if self.op == "NOT" else f"({text} {self.op})"


@dataclass(frozen=True, eq=False)
class Match(Expression):
    kind: str
    of: Expression
    text: str

    def parts(self) -> Sequence[Expression]:
        return (self.of,)

    def column(self) -> SparkColumn:
        c = self.of.column()
        if self.kind == "like":
            return F.like(c, F.lit(self.text), F.lit(_NO_ESCAPE))
        if self.kind == "ilike":
            return F.ilike(c, F.lit(self.text), F.lit(_NO_ESCAPE))
        return getattr(c, self.kind)(self.text)

    def _sql(self, d: Dialect) -> str:
        text, own = Literal(self.text)._sql(d), self.of._sql(d)
        if self.kind == "like":
            return f"({own} LIKE {text})"
        if self.kind == "ilike":
            return f"({own} ILIKE {text})" if d.has_ilike else f"(LOWER({own}) LIKE LOWER({text}))"
        if self.kind == "contains":
            return d.contains.format(own, text)
        n = len(self.text)
        return f"({'LEFT' if self.kind == 'startswith' else 'RIGHT'}({own}, {n}) = {text})"


@dataclass(frozen=True, eq=False)
class In(Expression):
    of: Expression
    values: tuple[Expression, ...]

    def parts(self) -> Sequence[Expression]:
        return (self.of, *self.values)

    def column(self) -> SparkColumn:
        return self.of.column().isin(*[v.column() for v in self.values]) if self.values else F.lit(False)

    def _sql(self, d: Dialect) -> str:
        return f"({self.of._sql(d)} IN ({', '.join(v._sql(d) for v in self.values)}))" if self.values else "FALSE"


@dataclass(frozen=True, eq=False)
class Between(Expression):
    of: Expression
    low: Expression
    high: Expression

    def parts(self) -> Sequence[Expression]:
        return self.of, self.low, self.high

    def column(self) -> SparkColumn:
        return self.of.column().between(self.low.column(), self.high.column())

    def _sql(self, d: Dialect) -> str:
        return f"({self.of._sql(d)} BETWEEN {self.low._sql(d)} AND {self.high._sql(d)})"


@dataclass(frozen=True, eq=False)
class Cast(Expression):
    of: Expression
    kind: str

    def parts(self) -> Sequence[Expression]:
        return (self.of,)

    @property
    def name(self) -> str | None:
        return self.of.name

    def column(self) -> SparkColumn:
        base = self.kind.lower().strip()
        return self.of.column().cast("string" if base.startswith("varchar(") else _TYPES.get(base, base))

    def _sql(self, d: Dialect) -> str:
        return f"CAST({self.of._sql(d)} AS {self.kind})"


@dataclass(frozen=True, eq=False)
class When(Expression):
    test: Expression
    then: Expression
    other: Expression

    def parts(self) -> Sequence[Expression]:
        return self.test, self.then, self.other

    def column(self) -> SparkColumn:
        return F.when(self.test.column(), self.then.column()).otherwise(self.other.column())

    def _sql(self, d: Dialect) -> str:
        return f"CASE WHEN {self.test._sql(d)} THEN {self.then._sql(d)} ELSE {self.other._sql(d)} END"


@dataclass(frozen=True, eq=False)
class DateTrunc(Expression):
    unit: str
    of: Expression

    def parts(self) -> Sequence[Expression]:
        return (self.of,)

    def column(self) -> SparkColumn:
        return F.date_trunc(self.unit, self.of.column()).cast("timestamp_ntz")

    def _sql(self, d: Dialect) -> str:
        return d.date_trunc.format(self.of._sql(d), unit=Literal(self.unit)._sql(d), bare=self.unit.upper())


@dataclass(frozen=True, eq=False)
class Call(Expression):
    """A function by name; those that the library knows follow its rules, others are passed on."""

    function: str
    args: tuple[Expression, ...]
    distinct: bool = False

    def parts(self) -> Sequence[Expression]:
        return self.args

    def has_aggregate(self) -> bool:
        return self.function.upper() in AGGREGATES or super().has_aggregate()

    def column(self) -> SparkColumn:
        known, cols = self.function.upper(), [a.column() for a in self.args]
        if known == "COUNT":
            if isinstance(self.args[0], Star):
                return F.count(F.lit(1))
            return F.count_distinct(*cols) if self.distinct else F.count(cols[0])
        if known == "CONCAT":
            return F.concat_ws("", *[c.cast("string") for c in cols])
        if known == "LENGTH":
            return F.length(cols[0]).cast("bigint")
        return F.call_function(self.function.lower(), *cols)

    def _sql(self, d: Dialect) -> str:
        args = [a._sql(d) for a in self.args]
        if self.function.upper() == "CONCAT" and not d.concat_skips_null:
            args = [f"COALESCE(CAST({a} AS {d.text_type}), '')" for a in args]
        return f"{self.function}({'DISTINCT ' if self.distinct else ''}{', '.join(args)})"


@dataclass(frozen=True, eq=False)
class Alias(Expression):
    of: Expression
    key: str

    @property
    def name(self) -> str:
        return self.key

    def parts(self) -> Sequence[Expression]:
        return (self.of,)

    def column(self) -> SparkColumn:
        return self.of.column().alias(self.key)

    def _sql(self, d: Dialect) -> str:
        return self.of._sql(d)


@dataclass(frozen=True, eq=False)
class Order(Expression):
    """A sort key; NULLs come last either way."""

    of: Expression
    descending: bool

    def parts(self) -> Sequence[Expression]:
        return (self.of,)

    def column(self) -> SparkColumn:
        c = self.of.column()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()

    def _sql(self, d: Dialect) -> str:
        return f"{self.of._sql(d)} {'DESC' if self.descending else 'ASC'} NULLS LAST"


def wrap(value: Any) -> Expression:
    """An expression as it is, anything else as a literal."""
    return value if isinstance(value, Expression) else Literal(value)


def expression(value: Any) -> Expression:
    """An expression as it is, text as raw SQL, anything else as a literal."""
    return Raw(value) if isinstance(value, str) else wrap(value)


def strip(e: Expression) -> Expression:
    """Without its alias or sort direction."""
    return strip(e.of) if isinstance(e, (Alias, Order)) else e


def col(name: str, table: str | None = None) -> Col:
    return Col(name, table)


def lit(value: Any) -> Literal:
    return Literal(value)


def star() -> Star:
    return Star()
