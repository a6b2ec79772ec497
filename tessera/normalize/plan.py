"""Nested schemas as relational tables, and nested rows as the tables' rows.

A plan holds, per table, the steps that make its columns.  They serve twice: to say the tables' schemas, and to shred a DataFrame.
Keys are made of the rows' content (or of columns that the caller names), so that a table computed anew has the same keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import NormalizationError
from tessera.lineage import Lineage
from tessera.schema import Path, Schema
from tessera.types import FieldType, to_spark
from tessera.types.core import fields_of
from tessera.types.semantic import JSON_BLOB

ID, PARENT, ORDINAL, VALUE = "__id", "__parent_id", "__ordinal", "value"

#: A strategy says for a list or a struct: "extract", "flatten" or "inline".
Strategy = Callable[[FieldType, int], str]


def _first_normal_form(t: FieldType, limit: int) -> str:
    return "extract" if t.is_list else "flatten"


def _documents(t: FieldType, limit: int) -> str:
    return "inline"


def _small_inline(t: FieldType, limit: int) -> str:
    if t.is_list and t.cardinality_estimate is not None and t.cardinality_estimate <= limit:
        return "inline"
    return _first_normal_form(t, limit)


STRATEGIES: dict[str, Strategy] = {"1nf": _first_normal_form, "mongo": _documents, "inline_small": _small_inline}


@dataclass(frozen=True)
class ForeignKey:
    child_table: str
    child_column: str
    parent_table: str
    parent_column: str

    def __repr__(self) -> str:
        return f"{self.child_table}.{self.child_column} -> {self.parent_table}.{self.parent_column}"


@dataclass(frozen=True)
class Step:
    """A column of a table: taken from a path of the parent row, as it is or as JSON."""

    name: str
    source: tuple[str, ...]
    as_json: bool = False


@dataclass
class TablePlan:
    schema: Schema
    steps: list[Step]
    parent: str | None = None
    array: tuple[str, ...] = ()  # where the rows are, in a row of the parent
    scalar: bool = False


@dataclass
class NormalizationPlan:
    tables: list[Schema]
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    lineage: Lineage = field(default_factory=Lineage)
    steps: dict[str, TablePlan] = field(default_factory=dict)

    @property
    def root_table(self) -> Schema:
        if not self.tables:
            raise NormalizationError("the plan has no tables")
        return self.tables[0]

    def table_names(self) -> list[str]:
        return [t.name for t in self.tables]

    def get_table(self, name: str) -> Schema | None:
        return next((t for t in self.tables if t.name == name), None)

    def apply(self, df: DataFrame, keys: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables' rows from rows of the nested schema.

        __id is the hash of a row's key columns, or of all of the row; rows that are equal are told apart by a number, for which alone the root is
        shuffled.  A child's id is its parent's, its field and its ordinal.
        """
        if missing := [c for s in self.steps[self.root_table.name].steps if (c := s.source[0]) not in df.columns]:
            raise NormalizationError(f"no column {missing[0]!r} to normalize")
        columns = keys or df.columns
        content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).cast("binary"), 256)
        rows = df.withColumn(ID, content)
        if not keys:
            again = F.row_number().over(Window.partitionBy(ID).orderBy(ID)) - 1
            rows = rows.withColumn(ID, F.when(again > 0, F.concat_ws("~", ID, again.cast("string"))).otherwise(F.col(ID)))
        out: dict[str, DataFrame] = {}
        nested: dict[str, tuple[DataFrame, Callable[[tuple[str, ...]], Column]]] = {}
        for name in self._parents_first():
            plan = self.steps[name]
            if plan.parent is None:
                nested[name] = rows, lambda source: F.col(".".join(f"`{s}`" for s in source))
                head = [F.col(ID)]
            else:
                above, column = nested[plan.parent]
                exploded = above.select(F.col(ID).alias(PARENT), F.posexplode(column(plan.array)).alias(ORDINAL, "__row"))
                own = exploded.withColumn(ORDINAL, F.col(ORDINAL).cast("bigint")).withColumn(ID, F.concat_ws(":", PARENT, F.lit(".".join(plan.array)), F.col(ORDINAL).cast("string")))
                if plan.scalar:
                    nested[name] = own, lambda source: F.col("__row")
                else:
                    nested[name] = own, lambda source: F.col("__row." + ".".join(f"`{s}`" for s in source))
                head = [F.col(ID), F.col(PARENT), F.col(ORDINAL)]
            frame, column = nested[name]
            out[name] = frame.select(*head, *[(F.to_json(column(s.source)) if s.as_json else column(s.source)).alias(s.name) for s in plan.steps])
        return {name: out[name] for name in self.table_names()}

    def _parents_first(self) -> list[str]:
        done: list[str] = []
        while len(done) < len(self.steps):
            done += [n for n, p in self.steps.items() if n not in done and (p.parent is None or p.parent in done)]
        return done

    def __repr__(self) -> str:
        return f"NormalizationPlan({', '.join(self.table_names())})"


def _key(description: str) -> FieldType:
    return FieldType(pa.string(), description=description, tags=("key",))


def normalize(schema: Schema, strategy: str = "1nf", inline_threshold: int = 5, recursive: bool = False) -> NormalizationPlan:
    """The plan for a schema.

    1nf: lists become child tables, structs columns; mongo: both become JSON; inline_small: lists with few values become JSON, else as 1nf; any other name is 1nf.
    recursive: structs within structs are flattened too, and lists within structs extracted; by default one level is, and what is deeper stays nested.
    """
    choose = STRATEGIES.get(strategy, _first_normal_form)
    plan = NormalizationPlan([])

    def table(name: str, fields: list[tuple[str, FieldType]], parent: str | None, array: tuple[str, ...], scalar: bool = False) -> list[Schema]:
        columns: list[tuple[str, FieldType]] = [(ID, _key("surrogate key"))]
        if parent is not None:
            columns += [(PARENT, _key(f"key of {parent}")), (ORDINAL, FieldType(pa.int64(), description="place in the list", tags=("key",)))]
            plan.foreign_keys.append(ForeignKey(name, PARENT, parent, ID))
        own = TablePlan(Schema(name), [], parent, array, scalar)
        plan.steps[name] = own
        children: list[Schema] = []

        def add(column: str, t: FieldType, source: tuple[str, ...], level: int) -> None:
            nested = t.is_list or t.is_struct
            action = choose(t, inline_threshold) if nested and not column.startswith("__") else "keep"
            if action == "inline":
                columns.append((column, t.evolve(arrow_type=pa.string(), semantic=JSON_BLOB)))
                own.steps.append(Step(column, source, True))
                plan.lineage.record(Path.parse(f"{name}.{'.'.join(source)}"), Path() / name / column, "inline_json")
            elif action == "extract" and (level == 0 or recursive):
                child, element = f"{name}__{column}", t.arrow_type.value_type
                plan.lineage.record(Path.parse(f"{name}.{'.'.join(source)}"), Path() / child, "extract_array")
                if pa.types.is_struct(element):
                    children.extend(table(child, [(f.name, FieldType(f.type)) for f in fields_of(element)], name, source))
                else:
                    children.extend(table(child, [(VALUE, FieldType(element))], name, source, True))
            elif action == "flatten" and (level == 0 or recursive):
                for f in fields_of(t.arrow_type):
                    inner = FieldType(f.type, source_path=".".join((*source, f.name)), null_ratio=t.null_ratio)
                    plan.lineage.record(Path.parse(f"{name}.{'.'.join((*source, f.name))}"), Path() / name / f"{column}__{f.name}", "flatten")
                    add(f"{column}__{f.name}", inner, (*source, f.name), level + 1)
            else:
                columns.append((column, t))
                own.steps.append(Step(column, source))

        for column, t in fields:
            add(column, t, (column,), 0)
        own.schema = Schema(name, tuple(columns))
        return [own.schema, *children]

    plan.tables = table(schema.name, list(schema.fields), None, ())
    return plan


def spark_schema(t: Schema) -> str:
    """DDL text of a table's columns, as Spark reads it."""
    return ", ".join(f"`{n}` {to_spark(k.arrow_type).simpleString()}" for n, k in t.fields)
