"""Schemas: ordered named descriptors, immutable."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from tessera.errors import PathNotFoundError
from tessera.schema.path import Path
from tessera.types.codec import decode, encode
from tessera.types.core import FieldType, fields_of
from tessera.types.interop import from_arrow_field, from_spark, to_arrow_field, to_spark


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[tuple[str, FieldType], ...] = ()

    # --- access

    @property
    def field_names(self) -> list[str]:
        return [name for name, _ in self.fields]

    def get_field(self, name: str) -> FieldType | None:
        return next((t for n, t in self.fields if n == name), None)

    def field(self, name: str) -> FieldType:
        found = self.get_field(name)
        if found is None:
            raise PathNotFoundError(f"{self.name} has no field {name!r}")
        return found

    def path(self, path: str | Path) -> FieldType:
        """The descriptor at a path; within a column it has the type alone."""
        p = Path.parse(path) if isinstance(path, str) else path
        if p.is_root():
            raise PathNotFoundError(f"the root of {self.name} is no field")
        at = self.field(p.segments[0].name)
        for s in p.segments[1:]:
            if s.kind == "array_element" and at.is_list:
                at = FieldType(at.arrow_type.value_type)
            elif s.kind == "field" and at.is_struct and at.arrow_type.get_field_index(s.name) >= 0:
                at = FieldType(at.arrow_type.field(s.name).type)
            else:
                raise PathNotFoundError(f"{self.name} has nothing at {p}")
        return at

    def __contains__(self, name: str) -> bool:
        return self.get_field(name) is not None

    def __len__(self) -> int:
        return len(self.fields)

    # --- traversal

    def walk(self) -> Iterator[tuple[Path, FieldType]]:
        """Every node with its path, parents before children."""

        def below(path: Path, t: FieldType) -> Iterator[tuple[Path, FieldType]]:
            yield path, t
            if t.is_list:
                yield from below(path.array_element(), FieldType(t.arrow_type.value_type))
            elif t.is_struct:
                for f in fields_of(t.arrow_type):
                    yield from below(path / f.name, FieldType(f.type))

        for name, t in self.fields:
            yield from below(Path() / name, t)

    def walk_arrays(self) -> Iterator[tuple[Path, FieldType]]:
        return ((p, t) for p, t in self.walk() if t.is_list)

    # --- change, by copy

    def add_field(self, name: str, ftype: FieldType) -> Schema:
        """With the field at the end, in place of one of that name."""
        return Schema(self.name, (*self.drop_field(name).fields, (name, ftype)))

    def drop_field(self, name: str) -> Schema:
        return Schema(self.name, tuple(f for f in self.fields if f[0] != name))

    def rename(self, new_name: str) -> Schema:
        return Schema(new_name, self.fields)

    # --- interchange

    def to_arrow(self) -> pa.Schema:
        return pa.schema([to_arrow_field(n, t) for n, t in self.fields])

    @classmethod
    def from_arrow(cls, name: str, schema: pa.Schema) -> Schema:
        return cls(name, tuple((f.name, from_arrow_field(f)) for f in schema))

    def to_spark(self) -> T.StructType:
        """A schema to read with; what is known about a column is in its metadata."""
        out = T.StructType()
        for n, t in self.fields:
            meta = {k: v for k in ("semantic", "pii_class", "description", "source_path") if (v := getattr(t, k)) is not None}
            out.add(T.StructField(n, to_spark(t.arrow_type), True, meta))
        return out

    @classmethod
    def from_spark(cls, name: str, schema: T.StructType) -> Schema:
        known = ("semantic", "pii_class", "description", "source_path")
        return cls(name, tuple((f.name, FieldType(from_spark(f.dataType), **{k: (f.metadata or {}).get(k) for k in known})) for f in schema.fields))

    def to_json(self) -> dict[str, Any]:
        return {"name": self.name, "fields": [{"name": n, "type": type_to_json(t)} for n, t in self.fields]}

    @classmethod
    def from_json(cls, data: dict[str, Any]) -> Schema:
        return cls(data["name"], tuple((f["name"], type_from_json(f["type"])) for f in data["fields"]))

    def __repr__(self) -> str:
        return f"Schema({self.name!r}, [{', '.join(f'{n}: {encode(t.arrow_type)}' for n, t in self.fields)}])"


def _plain(v: Any) -> Any:
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.hex() if isinstance(v, bytes) else v


def type_to_json(t: FieldType) -> dict[str, Any]:
    """Attributes that differ from their defaults, and the type."""
    out: dict[str, Any] = {"arrow_type": encode(t.arrow_type)}
    for f in fields(FieldType):
        if f.name != "arrow_type" and (v := getattr(t, f.name)) != f.default:
            out[f.name] = list(v) if f.name == "tags" else _plain(v)
    return out


def type_from_json(data: dict[str, Any]) -> FieldType:
    known = {f.name for f in fields(FieldType)} - {"arrow_type", "tags"}
    return FieldType(decode(data["arrow_type"]), tags=tuple(data.get("tags", ())), **{k: v for k, v in data.items() if k in known})
