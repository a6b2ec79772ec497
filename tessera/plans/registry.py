"""Where queries over the test tables are registered, with the SQL they are checked against."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import Table
from tessera.sources import ParquetSource

Query = Callable[[SparkSession, str], DataFrame]

_found: dict[str, tuple[Query, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table.from_source(ParquetSource(f"{sf_dir}/{name}.parquet"), spark)


def dsl(name: str, sql: str | None, *tables: str):
    """Register a query made of Tables."""

    def put(build: Callable[..., Table]):
        _found[name] = (lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in tables]).dataframe(spark)), sql
        return build

    return put


def frame(name: str, sql: str | None = None):
    """Register a query made of DataFrames."""

    def put(build: Query):
        _found[name] = build, sql
        return build

    return put


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder; only a local master may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
