"""Table expressions as SQL text: each step is a SELECT over the one below in parentheses, so any order of steps is valid."""

from __future__ import annotations

from functools import singledispatch

from tessera.errors import PlanError
from tessera.functions.dialects import Dialect, get_dialect
from tessera.functions.expression import Alias, Expression, Order, Star, strip
from tessera.plans import logical as L


def to_sql(node: L.Node, dialect: str = "duckdb") -> str:
    return render(node, get_dialect(dialect))


def _item(e: Expression, d: Dialect) -> str:
    return e._sql(d) + (f" AS {d.ident(e.name)}" if isinstance(e, Alias) else "")


def _items(exprs, d: Dialect) -> str:
    return ", ".join(_item(e, d) for e in exprs)


def _source(node: L.Node, d: Dialect, alias: str) -> str:
    """What stands after FROM."""
    if isinstance(node, L.Scan):
        return f"{_name(node, d)} AS {alias}"
    return f"({render(node, d)}) AS {alias}"


def _name(node: L.Scan, d: Dialect) -> str:
    if not isinstance(node.source, str):
        raise PlanError("a DataFrame has no name in SQL; start from a named table")
    return d.ident(node.source)


@singledispatch
def render(node: L.Node, d: Dialect) -> str:
    raise TypeError(f"no SQL for {type(node).__name__}")


@render.register
def _(node: L.Scan, d) -> str:
    return f"SELECT * FROM {_name(node, d)}"


@render.register
def _(node: L.RawQuery, d) -> str:
    return node.sql


@render.register
def _(node: L.Filter, d) -> str:
    return f"SELECT * FROM {_source(node.child, d, '_f')} WHERE {strip(node.test)._sql(d)}"


@render.register
def _(node: L.Project, d) -> str:
    return f"SELECT {_items(node.exprs, d)} FROM {_source(node.child, d, '_p')}"


def _without(names, d: Dialect) -> str:
    if d.star_except is None:
        raise PlanError(f"{d.name} has no * without columns; give the table's columns, or select them")
    return f"* {d.star_except} ({', '.join(d.ident(n) for n in names)})"


@render.register
def _(node: L.Assign, d) -> str:
    own, value = L.columns_of(node.child), f"{strip(node.expr)._sql(d)} AS {d.ident(node.name)}"
    if own is None:  # the table's columns aren't known: the column is taken as a new one
        listed = f"*, {value}"
    else:
        listed = ", ".join(value if c == node.name else d.ident(c) for c in own) + ("" if node.name in own else f", {value}")
    return f"SELECT {listed} FROM {_source(node.child, d, '_a')}"


@render.register
def _(node: L.Drop, d) -> str:
    own = L.columns_of(node.child)
    listed = _without(node.names, d) if own is None else ", ".join(d.ident(c) for c in own if c not in node.names)
    return f"SELECT {listed} FROM {_source(node.child, d, '_d')}"


@render.register
def _(node: L.Rename, d) -> str:
    own, names = L.columns_of(node.child), dict(node.names)
    if own is None:
        listed = ", ".join([_without(names, d), *(f"{d.ident(a)} AS {d.ident(b)}" for a, b in names.items())])
    else:
        listed = ", ".join(f"{d.ident(c)} AS {d.ident(names[c])}" if c in names else d.ident(c) for c in own)
    return f"SELECT {listed} FROM {_source(node.child, d, '_r')}"


@render.register
def _(node: L.Join, d) -> str:
    left, right = L.columns_of(node.left), L.columns_of(node.right)
    tables = f"{_source(node.left, d, d.ident('_left'))} {{}} {_source(node.right, d, d.ident('_right'))}"
    if node.how in ("semi", "anti"):
        test = f"SELECT 1 FROM {_source(node.right, d, d.ident('_right'))} WHERE {strip(node.on)._sql(d)}"
        return f"SELECT * FROM {_source(node.left, d, d.ident('_left'))} WHERE {'NOT ' if node.how == 'anti' else ''}EXISTS ({test})"
    listed = "*"
    if left is not None and right is not None:
        one, two = d.ident("_left"), d.ident("_right")
        listed = ", ".join([*(f"{one}.{d.ident(c)}" for c in left), *(f"{two}.{d.ident(c)} AS {d.ident(n)}" for c, n in zip(right, L.suffixed(left, right), strict=True))])
    if node.how == "cross":
        return f"SELECT {listed} FROM {tables.format('CROSS JOIN')}"
    return f"SELECT {listed} FROM {tables.format(node.how.upper() + ' JOIN')} ON {strip(node.on)._sql(d)}"


@render.register
def _(node: L.Aggregate, d) -> str:
    by = f" GROUP BY {', '.join(strip(k)._sql(d) for k in node.keys)}" if node.keys else ""
    return f"SELECT {_items((*node.keys, *node.aggs), d)} FROM {_source(node.child, d, '_g')}{by}"


def _keys(keys, d: Dialect) -> str:
    return ", ".join((k if isinstance(k, Order) else Order(k, False))._sql(d) for k in keys)


@render.register
def _(node: L.Sort, d) -> str:
    return f"SELECT * FROM {_source(node.child, d, '_s')} ORDER BY {_keys(node.keys, d)}"


@render.register
def _(node: L.Limit, d) -> str:
    # a sort below belongs to the same SELECT: the order of a subquery's rows is no promise
    below = render(node.child, d) if isinstance(node.child, L.Sort) else f"SELECT * FROM {_source(node.child, d, '_l')}"
    return f"{below} LIMIT {node.n}" + (f" OFFSET {node.offset}" if node.offset else "")


@render.register
def _(node: L.Union, d) -> str:
    if node.by_name:
        own = L.columns_of(node.left)
        if own is None:
            raise PlanError("a union by name needs the left side's columns")
        right = L.Project(node.right, tuple(_column(c) for c in own))
    else:
        right = node.right
    return f"({render(node.left, d)}) UNION {'ALL' if node.all else 'DISTINCT' if d.name == 'bigquery' else ''} ({render(right, d)})".replace("  ", " ")


def _column(name: str) -> Expression:
    from tessera.functions.expression import Col

    return Col(name)


@render.register
def _(node: L.Distinct, d) -> str:
    return f"SELECT DISTINCT * FROM {_source(node.child, d, '_u')}"


@render.register
def _(node: L.Windowed, d) -> str:
    clauses = [f"PARTITION BY {', '.join(strip(e)._sql(d) for e in node.partition_by)}"] if node.partition_by else []
    clauses += [f"ORDER BY {_keys(node.order_by, d)}"] if node.order_by else []
    over = f"OVER ({' '.join(clauses)})"
    listed = ", ".join([Star()._sql(d), *(f"{strip(e)._sql(d)} {over} AS {d.ident(e.name or strip(e)._sql(d))}" for e in node.exprs)])
    return f"SELECT {listed} FROM {_source(node.child, d, '_w')}"
