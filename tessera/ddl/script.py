"""CREATE TABLE for schemas and plans, ALTER TABLE for their changes."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.ddl.dialects import DDLOptions, get_dialect
from tessera.diff import SchemaDiff
from tessera.errors import DDLCompilationError
from tessera.normalize import NormalizationPlan
from tessera.schema import Schema


@dataclass
class DDLScript:
    dialect: str
    statements: list[str] = field(default_factory=list)

    def add(self, statement: str) -> None:
        self.statements.append(statement)

    def to_sql(self) -> str:
        return "\n\n".join(self.statements)

    __str__ = to_sql


def compile_ddl(what: Schema | NormalizationPlan, dialect: str = "duckdb", options: DDLOptions | None = None) -> DDLScript:
    """Tables, parents first, then their foreign keys where the dialect can add them."""
    d, options = get_dialect(dialect), options or DDLOptions()
    if isinstance(what, Schema):
        return DDLScript(d.name, [d.create_table(what.name, what.fields, options)])
    if not isinstance(what, NormalizationPlan):
        raise DDLCompilationError(f"tables are made of a Schema or a NormalizationPlan, not of {type(what).__name__}")
    script = DDLScript(d.name, [d.create_table(t.name, t.fields, options) for t in what.tables])
    for fk in what.foreign_keys:
        if statement := d.foreign_key(fk, options):
            script.add(statement)
    return script


def compile_migration(schema_diff: SchemaDiff, dialect: str = "duckdb", table_name: str | None = None, options: DDLOptions | None = None, skip_breaking: bool = False) -> DDLScript:
    """Statements for the changes; breaking ones raise, or with skip_breaking leave a comment."""
    d, options = get_dialect(dialect), options or DDLOptions()
    table, script = table_name or schema_diff.new_name, DDLScript(d.name)
    if schema_diff.has_breaking_changes and not skip_breaking:
        found = "; ".join(c.description for c in schema_diff.filter("breaking").changes)
        raise DDLCompilationError(f"breaking changes: {found}. skip_breaking leaves them out.")
    for c in schema_diff.changes:
        name = str(c.path)
        if c.severity == "breaking":
            script.add(f"-- skipped, breaking: {c.description}")
        elif c.kind == "added":
            script.add(d.add_column(table, name, c.new_type, options))
        elif c.kind == "removed":
            script.add(d.drop_column(table, name, options))
        elif c.kind == "type_changed":
            script.add(d.change_type(table, name, c.new_type, options))
        else:
            script.add(f"-- {c.severity}: {c.description}")
    return script
