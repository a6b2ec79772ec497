"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir; where it is unset, a folder of this session's own, which only a local master can share with its executors."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{folder(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Rows that go to a Python worker at a time where a table is written: documents can be long, and both sides hold whole batches.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most while a table is written; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet, in a folder for each value of `by` if given, and return what was written: later readers neither recompute df nor depend on the executors that made it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with small_batches(spark):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables, once nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, df._written)


def drop_part(table: DataFrame, part: str) -> None:
    """Delete a folder, as by=value, of a table that was written by a column, once nothing reads it any more."""
    _delete(table.sparkSession, f"{table._written}/{part}")


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written: results are lazy and read it, so call this when they have been used."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
