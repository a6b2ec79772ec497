"""Lazy tables: each method gives a new one; nothing runs before a DataFrame is asked for."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import PlanError
from tessera.functions.expression import Col, Expression, expression
from tessera.plans import logical as L
from tessera.plans.lower import lower
from tessera.plans.sql import to_sql

# Kinds of join, and other names for them.
JOINS = ("inner", "left", "right", "full", "cross", "semi", "anti")
_ALSO = {"outer": "full", "full_outer": "full", "left_outer": "left", "right_outer": "right", "left_semi": "semi", "left_anti": "anti"}


class Table:
    """A table by name or path, or a DataFrame, and what is to be done with it.

    Lowering goes to the DataFrame API, so pushdown, pruning, join order and physical operators are Spark's; to_sql() writes the
    same for another database.
    """

    def __init__(self, source: str | DataFrame | L.Node, schema: Any = None):
        if isinstance(source, L.Node):
            self.plan = source
        else:
            names = getattr(schema, "field_names", None) or getattr(schema, "names", None)
            self.plan = L.Scan(source, tuple(names) if names else None)

    @classmethod
    def from_source(cls, source: Any, spark: SparkSession | None = None) -> Table:
        """From a connector of tessera.sources."""
        return cls(source.dataframe(spark or SparkSession.active()))

    @classmethod
    def from_sql(cls, sql: str) -> Table:
        return cls(L.RawQuery(sql))

    # --- rows
    def filter(self, test: Any) -> Table:
        return Table(L.Filter(self.plan, expression(test)))

    where = filter

    def distinct(self) -> Table:
        return Table(L.Distinct(self.plan))

    def limit(self, n: int, offset: int = 0) -> Table:
        return Table(L.Limit(self.plan, n, offset))

    def head(self, n: int = 5) -> Table:
        return self.limit(n)

    def sort(self, *keys: Any) -> Table:
        """Ascending unless a key says desc(); NULLs last."""
        return Table(L.Sort(self.plan, tuple(expression(k) for k in keys)))

    order_by = sort

    # --- columns
    def select(self, *exprs: Any) -> Table:
        """Expressions; with aggregates alone, one row."""
        own = tuple(expression(e) for e in exprs)
        if own and all(e.has_aggregate() for e in own):
            return Table(L.Aggregate(self.plan, (), own))
        return Table(L.Project(self.plan, own))

    def with_column(self, name: str, expr: Any) -> Table:
        return Table(L.Assign(self.plan, name, expression(expr)))

    def with_columns(self, **exprs: Any) -> Table:
        out = self
        for name, e in exprs.items():
            out = out.with_column(name, e)
        return out

    def drop(self, *names: str) -> Table:
        return Table(L.Drop(self.plan, names))

    def rename(self, **names: str) -> Table:
        """old=new."""
        return Table(L.Rename(self.plan, tuple(names.items())))

    @property
    def columns(self) -> list[str] | None:
        return L.columns_of(self.plan)

    # --- groups
    def group_by(self, *keys: Any) -> GroupedTable:
        return GroupedTable(self, tuple(expression(k) for k in keys))

    def window(self, partition_by: Any = (), order_by: Any = ()) -> WindowTable:
        many = lambda x: tuple(expression(e) for e in (x if isinstance(x, (list, tuple)) else (x,)))
        return WindowTable(self, many(partition_by), many(order_by))

    # --- two tables
    def join(self, other: Table, on: Any = None, how: str = "inner") -> Table:
        """on: an expression over col(name, "_left") and col(name, "_right"), or the name, or names, of columns that both have.

        Of the right side's columns, those whose name the left has too get _1.
        """
        kind = how.lower().replace(" ", "_")
        kind = _ALSO.get(kind, kind)
        if kind not in JOINS:
            raise PlanError(f"no join {how!r}; there are {', '.join(JOINS)}")
        if isinstance(on, (str, list, tuple)):
            tests = [Col(k, "_left") == Col(k, "_right") for k in ([on] if isinstance(on, str) else on)]
            on = tests[0]
            for t in tests[1:]:
                on = on & t
        if on is None and kind != "cross":
            raise PlanError(f"a {kind} join needs a condition")
        return Table(L.Join(self.plan, other.plan, None if kind == "cross" else on, kind))

    def union(self, other: Table, all: bool = True, by_name: bool = False) -> Table:  # noqa: A002
        return Table(L.Union(self.plan, other.plan, all, by_name))

    # --- results
    def dataframe(self, spark: SparkSession | None = None) -> DataFrame:
        return lower(self.plan, spark)

    def to_sql(self, dialect: str = "duckdb") -> str:
        try:
            return to_sql(self.plan, dialect)
        except ValueError as e:
            raise PlanError(str(e)) from e

    def to_arrow(self, spark: SparkSession | None = None):
        return self.dataframe(spark).toArrow()

    def explain(self, spark: SparkSession | None = None, mode: str = "formatted") -> None:
        self.dataframe(spark).explain(mode)

    def __repr__(self) -> str:
        return f"Table({type(self.plan).__name__})"


class GroupedTable:
    def __init__(self, table: Table, keys: tuple[Expression, ...]):
        self.table, self.keys = table, keys

    def agg(self, *exprs: Any, **named: Any) -> Table:
        """Keys and aggregates; without keys one row, without aggregates the distinct keys."""
        aggs = [expression(e) for e in exprs] + [expression(e).alias(n) for n, e in named.items()]
        return Table(L.Aggregate(self.table.plan, self.keys, tuple(aggs)))


class WindowTable:
    """Beyond the plain operators: functions over partitions in order."""

    def __init__(self, table: Table, partition_by: tuple[Expression, ...], order_by: tuple[Expression, ...]):
        self.table, self.partition_by, self.order_by = table, partition_by, order_by

    def over(self, *exprs: Any) -> Table:
        """All columns, and each expression over the window."""
        own = tuple(expression(e) for e in exprs)
        return Table(L.Windowed(self.table.plan, self.partition_by, self.order_by, own)) if own else self.table


