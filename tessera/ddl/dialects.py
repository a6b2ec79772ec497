"""How each warehouse writes tables: types, quotes, what a column and a table may say."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa

from tessera.errors import DDLCompilationError
from tessera.types import FieldType, encode
from tessera.types.core import fields_of, is_list
from tessera.types.semantic import JSON_BLOB

# The names of plain types in each dialect.
TYPES: dict[str, dict[str, str]] = {
    "base": {
        "null": "VARCHAR", "bool": "BOOLEAN", "int8": "SMALLINT", "int16": "SMALLINT", "int32": "INTEGER", "int64": "BIGINT",
        "uint8": "SMALLINT", "uint16": "INTEGER", "uint32": "BIGINT", "uint64": "BIGINT", "float16": "REAL", "float32": "REAL", "float64": "DOUBLE PRECISION",
        "string": "VARCHAR", "large_string": "VARCHAR", "binary": "BYTEA", "date32": "DATE", "date64": "DATE",
    },
    "duckdb": {
        "int8": "TINYINT", "uint8": "UTINYINT", "uint16": "USMALLINT", "uint32": "UINTEGER", "uint64": "UBIGINT",
        "float16": "FLOAT", "float32": "FLOAT", "float64": "DOUBLE", "binary": "BLOB",
    },
    "postgres": {"large_string": "TEXT"},
    "redshift": {"null": "VARCHAR(65535)", "string": "VARCHAR(65535)", "large_string": "VARCHAR(65535)", "binary": "VARBYTE"},
    "bigquery": {
        "null": "STRING", "bool": "BOOL", "int8": "INT64", "int16": "INT64", "int32": "INT64", "int64": "INT64",
        "uint8": "INT64", "uint16": "INT64", "uint32": "INT64", "uint64": "INT64", "float16": "FLOAT64", "float32": "FLOAT64", "float64": "FLOAT64",
        "string": "STRING", "large_string": "STRING", "binary": "BYTES",
    },
    "snowflake": {
        "int8": "NUMBER(3,0)", "int16": "NUMBER(5,0)", "int32": "NUMBER(10,0)", "int64": "NUMBER(19,0)",
        "uint8": "NUMBER(3,0)", "uint16": "NUMBER(5,0)", "uint32": "NUMBER(10,0)", "uint64": "NUMBER(20,0)",
        "float16": "FLOAT", "float32": "FLOAT", "float64": "FLOAT", "binary": "BINARY",
    },
    "databricks": {
        "null": "STRING", "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20,0)",
        "float16": "FLOAT", "float32": "FLOAT", "float64": "DOUBLE", "string": "STRING", "large_string": "STRING", "binary": "BINARY",
    },
}


@dataclass
class DDLOptions:
    if_not_exists: bool = False
    include_comments: bool = True
    primary_key: str | None = "__id"
    schema_prefix: str | None = None
    extra_options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Dialect:
    name: str
    json: str
    list_of: Callable[[str], str]
    struct_of: Callable[[list[tuple[str, str]]], str]
    timestamp: str = "TIMESTAMP"
    timestamp_tz: str = "TIMESTAMP"
    quote: str = '"'
    says_null: bool = True
    says_not_null: bool = True
    primary_keys: bool = True
    #: Whether FOREIGN KEY can be added to a table that exists.
    foreign_keys: bool = True
    comment: Callable[[str], str] | None = None
    tail: Callable[[dict[str, Any], Callable[[str], str]], list[str]] = lambda options, ident: []
    alter_type: str = "ALTER TABLE {table} ALTER COLUMN {column} TYPE {type}"
    fallback: str = "VARCHAR"

    def ident(self, name: str) -> str:
        return self.quote + name.replace(self.quote, self.quote * 2) + self.quote

    def table(self, name: str, options: DDLOptions) -> str:
        return (f"{self.ident(options.schema_prefix)}." if options.schema_prefix else "") + self.ident(name)

    def type_of(self, t: pa.DataType, semantic: str | None = None) -> str:
        if semantic == JSON_BLOB or pa.types.is_map(t):
            return self.json
        if pa.types.is_timestamp(t):
            return self.timestamp_tz if t.tz else self.timestamp
        if pa.types.is_decimal(t):
            return f"DECIMAL({t.precision},{t.scale})"
        if is_list(t):
            return self.list_of(self.type_of(t.value_type))
        if pa.types.is_struct(t):
            return self.struct_of([(f.name, self.type_of(f.type)) for f in fields_of(t)])
        return (TYPES["base"] | TYPES[self.name]).get(encode(t), self.fallback)

    def column(self, name: str, t: FieldType, options: DDLOptions) -> tuple[str, str]:
        """The definition, and a comment that goes after the comma if the dialect has none of its own."""
        text = f"{self.ident(name)} {self.type_of(t.arrow_type, t.semantic)}"
        if self.says_not_null and not t.is_nullable:
            text += " NOT NULL"
        elif self.says_null and t.is_nullable:
            text += " NULL"
        note = " ".join((t.description or "").split()) if options.include_comments else ""
        if note and self.comment:
            return f"{text} {self.comment(note.replace(chr(39), chr(39) * 2))}", ""
        return text, f" -- {note}" if note else ""

    def create_table(self, name: str, fields, options: DDLOptions) -> str:
        items = [self.column(n, t, options) for n, t in fields]
        if self.primary_keys and options.primary_key in [n for n, _ in fields]:
            items.append((f"PRIMARY KEY ({self.ident(options.primary_key)})", ""))
        body = "\n".join(f"  {text}{',' if i + 1 < len(items) else ''}{note}" for i, (text, note) in enumerate(items))
        head = f"CREATE TABLE {'IF NOT EXISTS ' if options.if_not_exists else ''}{self.table(name, options)} (\n{body}\n)"
        return "\n".join([head, *self.tail(options.extra_options, self.ident)]) + ";"

    def add_column(self, table: str, name: str, t: FieldType, options: DDLOptions) -> str:
        return f"ALTER TABLE {self.table(table, options)} ADD COLUMN {self.ident(name)} {self.type_of(t.arrow_type, t.semantic)};"

    def drop_column(self, table: str, name: str, options: DDLOptions) -> str:
        return f"ALTER TABLE {self.table(table, options)} DROP COLUMN {self.ident(name)};"

    def change_type(self, table: str, name: str, t: FieldType, options: DDLOptions) -> str:
        return self.alter_type.format(table=self.table(table, options), column=self.ident(name), type=self.type_of(t.arrow_type, t.semantic)) + ";"

    def foreign_key(self, fk, options: DDLOptions) -> str | None:
        if not self.foreign_keys:
            return None
        return f"ALTER TABLE {self.table(fk.child_table, options)} ADD FOREIGN KEY ({self.ident(fk.child_column)}) REFERENCES {self.table(fk.parent_table, options)} ({self.ident(fk.parent_column)});"


def _many(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _redshift_tail(o, ident) -> list[str]:
    out = [f"DISTKEY({ident(o['distkey'])})"] if o.get("distkey") else []
    if o.get("sortkey"):
        keys = _many(o["sortkey"])
        out.append(f"{'COMPOUND ' if len(keys) > 1 else ''}SORTKEY({', '.join(map(ident, keys))})")
    return out


def _bigquery_tail(o, ident) -> list[str]:
    out = [f"PARTITION BY DATE({ident(o['partition_by'])})"] if o.get("partition_by") else []
    return out + ([f"CLUSTER BY {', '.join(map(ident, _many(o['cluster_by'])))}"] if o.get("cluster_by") else [])


def _databricks_tail(o, ident) -> list[str]:
    return ["USING DELTA"] + ([f"PARTITIONED BY ({', '.join(map(ident, _many(o['partition_by'])))})"] if o.get("partition_by") else [])


def _quoted(mark: str, sep: str) -> Callable[[list[tuple[str, str]]], str]:
    return lambda fields: ", ".join(f"{mark}{n.replace(mark, mark * 2) if mark else n}{mark}{sep} {t}" for n, t in fields)


DIALECTS = {
    d.name: d
    for d in (
        Dialect("duckdb", "JSON", lambda t: f"{t}[]", lambda f: f"STRUCT({_quoted('"', '')(f)})", timestamp_tz="TIMESTAMPTZ", foreign_keys=False, alter_type="ALTER TABLE {table} ALTER COLUMN {column} SET DATA TYPE {type}"),
        Dialect("postgres", "JSONB", lambda t: f"{t}[]", lambda f: "JSONB", timestamp_tz="TIMESTAMPTZ"),
        Dialect("redshift", "SUPER", lambda t: "SUPER", lambda f: "SUPER", timestamp_tz="TIMESTAMPTZ", tail=_redshift_tail, fallback="VARCHAR(65535)"),
        Dialect("bigquery", "JSON", lambda t: f"ARRAY<{t}>", lambda f: f"STRUCT<{_quoted('', '')(f)}>", quote="`", says_null=False, says_not_null=False, primary_keys=False, foreign_keys=False, comment=lambda s: f"OPTIONS(description='{s}')", tail=_bigquery_tail, alter_type="ALTER TABLE {table} ALTER COLUMN {column} SET DATA TYPE {type}", fallback="STRING"),
        Dialect("snowflake", "VARIANT", lambda t: "ARRAY", lambda f: "OBJECT", timestamp="TIMESTAMP_NTZ", timestamp_tz="TIMESTAMP_TZ", says_null=False, comment=lambda s: f"COMMENT '{s}'", alter_type="ALTER TABLE {table} ALTER COLUMN {column} SET DATA TYPE {type}"),
        Dialect("databricks", "STRING", lambda t: f"ARRAY<{t}>", lambda f: f"STRUCT<{_quoted('`', ':')(f)}>", quote="`", says_null=False, primary_keys=False, foreign_keys=False, comment=lambda s: f"COMMENT '{s}'", tail=_databricks_tail, fallback="STRING"),
    )
}
DIALECTS["postgresql"] = DIALECTS["postgres"]


def get_dialect(name: str) -> Dialect:
    if name.lower() not in DIALECTS:
        raise DDLCompilationError(f"no dialect {name!r}; there are {', '.join(sorted(DIALECTS))}")
    return DIALECTS[name.lower()]
