"""Observations of documents: which types are seen at which paths."""

from __future__ import annotations

import datetime
import decimal
import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd

from tessera.errors import CyclicReferenceError

MAX_DEPTH = 50

#: Kinds of nodes that hold others; all other kinds are names of types.
STRUCT, LIST, NULL = "struct", "list", "null"

#: The kind, at no path, of documents that are left out: too deep, or no objects.
SKIPPED = "skipped"

OBSERVATION = "path string, kind string, value string, n long, first long"

# Types of Python values, in the order of tests (a bool is an int too, a datetime a date).
_KINDS = ((bool, "bool"), (int, "int64"), (float, "float64"), (str, "string"), (bytes, "binary"), (datetime.datetime, "timestamp[us]"), (datetime.date, "date32"), (decimal.Decimal, "decimal128(38,18)"))


def kind_of(value: Any) -> str:
    if value is None:
        return NULL
    return next((name for cls, name in _KINDS if isinstance(value, cls)), "string")


def walk(document: dict) -> Iterator[tuple[str, str, Any]]:
    """(path, kind, value) of each node, parents first; an empty list has one element of unknown type."""

    def below(path: str, value: Any, depth: int) -> Iterator[tuple[str, str, Any]]:
        if depth > MAX_DEPTH:
            raise CyclicReferenceError(f"nested more than {MAX_DEPTH} deep at {path}")
        if isinstance(value, dict):
            yield path, STRUCT, None
            for key, v in value.items():
                yield from below(f"{path}.{key}", v, depth + 1)
        elif isinstance(value, (list, tuple)):
            yield path, LIST, None
            for v in value:
                yield from below(path + "[]", v, depth + 1)
            if not value:
                yield path + "[]", "empty", None
        else:
            yield path, kind_of(value), value

    for key, v in document.items():
        yield from below(str(key), v, 1)


def text_of(value: Any) -> str | None:
    if value is None or isinstance(value, bytes):
        return value.hex() if value else None
    if isinstance(value, float) and math.isfinite(value):
        return repr(value)
    return str(value)


def observe(documents: Iterable[tuple[int, Any]]) -> dict[tuple[str, str, str | None], list[int]]:
    """(path, kind, value) -> [how often, when first], over (number, document); documents too deep, or no objects, are only counted, as SKIPPED."""
    seen: dict[tuple[str, str, str | None], list[int]] = {}
    for number, doc in documents:
        try:
            own = list(walk(doc)) if isinstance(doc, dict) else None
        except (CyclicReferenceError, RecursionError):
            own = None
        if own is None:
            seen.setdefault(("", SKIPPED, None), [0, number << 8])[0] += 1
            continue
        for place, (path, kind, value) in enumerate(own):
            got = seen.setdefault((path, kind, text_of(value)), [0, (number << 8) | min(place, 255)])
            got[0] += 1
    return seen


def observe_json(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: number and JSON text to observations, combined per batch.  Text that is no JSON raises, as a malformed line does in any reader."""
    for frame in frames:
        seen = observe((int(i), json.loads(text)) for i, text in zip(frame.number, frame.value) if text is not None and text.strip())
        rows = [(*key, *got) for key, got in seen.items()]
        yield pd.DataFrame(rows, columns=["path", "kind", "value", "n", "first"])
