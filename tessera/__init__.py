"""Schemas, relational tables and quality checks for semi-structured and tabular data, on Spark."""

from tessera.ddl import compile_ddl, compile_migration
from tessera.diff import diff
from tessera.functions import col, lit
from tessera.infer import infer
from tessera.normalize import normalize
from tessera.operators import Table
from tessera.schema import Path, Schema

__version__ = "0.1.0"

__all__ = ["Path", "Schema", "Table", "col", "compile_ddl", "compile_migration", "diff", "infer", "lit", "normalize"]
