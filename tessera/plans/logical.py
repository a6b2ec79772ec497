"""Nodes of a table expression.  They only say what is asked for: Spark's optimizer, or the target database, decides how."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from tessera.functions.expression import Expression


class Node:
    """A step of a table expression."""


@dataclass(frozen=True, eq=False)
class Scan(Node):
    """A named table, a path, or a DataFrame."""

    source: Any
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True, eq=False)
class RawQuery(Node):
    sql: str


@dataclass(frozen=True, eq=False)
class Filter(Node):
    child: Node
    test: Expression


@dataclass(frozen=True, eq=False)
class Project(Node):
    child: Node
    exprs: tuple[Expression, ...]


@dataclass(frozen=True, eq=False)
class Assign(Node):
    """All columns, with one replaced where it stands, or added."""

    child: Node
    name: str
    expr: Expression


@dataclass(frozen=True, eq=False)
class Drop(Node):
    child: Node
    names: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Rename(Node):
    child: Node
    names: tuple[tuple[str, str], ...]


@dataclass(frozen=True, eq=False)
class Join(Node):
    left: Node
    right: Node
    on: Expression | None
    how: str


@dataclass(frozen=True, eq=False)
class Aggregate(Node):
    child: Node
    keys: tuple[Expression, ...]
    aggs: tuple[Expression, ...]


@dataclass(frozen=True, eq=False)
class Sort(Node):
    child: Node
    keys: tuple[Expression, ...]


@dataclass(frozen=True, eq=False)
class Limit(Node):
    child: Node
    n: int
    offset: int = 0


@dataclass(frozen=True, eq=False)
class Union(Node):
    left: Node
    right: Node
    all: bool = True
    by_name: bool = False


@dataclass(frozen=True, eq=False)
class Distinct(Node):
    child: Node


@dataclass(frozen=True, eq=False)
class Windowed(Node):
    """All columns and expressions over a window."""

    child: Node
    partition_by: tuple[Expression, ...]
    order_by: tuple[Expression, ...]
    exprs: tuple[Expression, ...]


def columns_of(node: Node) -> list[str] | None:
    """The names of a node's columns, if they can be told without the data."""
    if isinstance(node, Scan):
        if hasattr(node.source, "columns"):
            return list(node.source.columns)
        return list(node.columns) if node.columns is not None else None
    if isinstance(node, Project):
        names = [e.name for e in node.exprs]
        return names if all(names) else None
    if isinstance(node, Aggregate):
        names = [e.name for e in (*node.keys, *node.aggs)]
        return names if all(names) else None
    if isinstance(node, Join):
        left, right = columns_of(node.left), columns_of(node.right)
        if node.how in ("semi", "anti"):
            return left
        return left + suffixed(left, right) if left is not None and right is not None else None
    if isinstance(node, Union):
        return columns_of(node.left)
    if isinstance(node, RawQuery):
        return None
    below = columns_of(node.child)
    if below is None:
        return None
    if isinstance(node, Assign):
        return below if node.name in below else [*below, node.name]
    if isinstance(node, Drop):
        return [c for c in below if c not in node.names]
    if isinstance(node, Rename):
        return [dict(node.names).get(c, c) for c in below]
    if isinstance(node, Windowed):
        names = [e.name for e in node.exprs]
        return [*below, *names] if all(names) else None
    return below


def suffixed(left: list[str], right: list[str]) -> list[str]:
    """Names of the right side's columns in a join: those that the left has too get the first of _1, _2 ... that is free."""
    taken, out = set(left), []
    for name in right:
        own, i = name, 0
        while own in taken:
            i += 1
            own = f"{name}_{i}"
        taken.add(own)
        out.append(own)
    return out
