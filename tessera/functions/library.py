"""Functions by name; text arguments are names of columns."""

from __future__ import annotations

from typing import Any

from tessera.functions.expression import Call, Cast, Col, DateTrunc, Expression, Star, When, wrap


def _operand(x: Any) -> Expression:
    return Col(x) if isinstance(x, str) else wrap(x)


def sum_(x: Any) -> Expression:
    return _operand(x).sum()


def avg_(x: Any) -> Expression:
    return _operand(x).avg()


def min_(x: Any) -> Expression:
    return _operand(x).min()


def max_(x: Any) -> Expression:
    return _operand(x).max()


def count_(x: Any = "*") -> Expression:
    return Call("COUNT", (Star(),)) if isinstance(x, str) and x == "*" else _operand(x).count()


def count_distinct_(x: Any) -> Expression:
    return _operand(x).count_distinct()


def coalesce(*args: Any) -> Expression:
    return Call("COALESCE", tuple(wrap(a) for a in args))


def concat(*args: Any) -> Expression:
    return Call("CONCAT", tuple(wrap(a) for a in args))


def length(x: Any) -> Expression:
    return Call("LENGTH", (_operand(x),))


def if_(test: Expression, then: Any, other: Any) -> Expression:
    return When(test, wrap(then), wrap(other))


def date_trunc(unit: str, x: Any) -> Expression:
    return DateTrunc(unit, _operand(x))


def to_date(x: Any) -> Expression:
    return Cast(_operand(x), "DATE")


def call(function: str, *args: Any) -> Expression:
    """Any function of the target, by its name."""
    return Call(function, tuple(wrap(a) for a in args))
