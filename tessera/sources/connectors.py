"""Connectors: each gives a DataFrame, so filters and columns are pushed into it by Spark; read() gives its rows as dicts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SourceError


@runtime_checkable
class Source(Protocol):
    def read(self) -> Iterator[dict]: ...

    def schema_hint(self) -> dict | None: ...


class _Frame:
    """Common to all: rows as dicts, a partition at a time."""

    def dataframe(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def read(self) -> Iterator[dict]:
        for row in self.dataframe(SparkSession.active()).toLocalIterator():
            yield row.asDict(recursive=True)

    def schema_hint(self) -> dict | None:
        return None


@dataclass
class JSONSource(_Frame):
    """Lines of JSON (.ndjson, .jsonl, or format="ndjson"), or files that are one value each: a list of objects, or one object.

    The DataFrame has the objects' text, so that nothing is lost before a schema is inferred; parsed() reads with a schema and fails on malformed text.
    """

    path: str
    format: str = "auto"

    @property
    def by_line(self) -> bool:
        return self.format in ("ndjson", "jsonl", "lines") or self.format == "auto" and bool(re.search(r"\.(ndjson|jsonl)(\.\w+)?$", self.path))

    def dataframe(self, spark: SparkSession) -> DataFrame:
        if self.by_line:
            return spark.read.text(self.path).where("trim(value) <> ''")
        files = spark.read.text(self.path, wholetext=True).select(F.parse_json("value").alias("v"))
        many = F.schema_of_variant("v").startswith("ARRAY")
        items = F.when(many, F.expr("try_variant_get(v, '$', 'array<variant>')")).when(F.schema_of_variant("v").startswith("OBJECT"), F.array("v"))
        return files.select(F.explode(items).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).select(F.to_json("v").alias("value"))

    def parsed(self, spark: SparkSession, schema: Any) -> DataFrame:
        return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not self.by_line).json(self.path)

    def read(self) -> Iterator[dict]:
        for row in self.dataframe(SparkSession.active()).toLocalIterator():
            yield json.loads(row.value)


@dataclass
class ParquetSource(_Frame):
    path: str
    batch_size: int = 1000

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def schema_hint(self) -> dict | None:
        from tessera.schema import Schema

        spark = SparkSession.active()
        return {"arrow_schema": Schema.from_spark("", self.dataframe(spark).schema).to_arrow()}


@dataclass
class PostgresSource(_Frame):
    """Over JDBC; the query goes before the table.  With partition_column, lower, upper and partitions the read is parallel."""

    connection_string: str
    query: str | None = None
    table: str | None = None
    batch_size: int = 1000
    partitioning: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.query and not self.table:
            raise ValueError("a query or a table is needed")

    def options(self) -> dict[str, str]:
        url = self.connection_string
        user = re.match(r"postgres(?:ql)?://(?:([^:@/]+)(?::([^@/]*))?@)?(.*)", url)
        out = {"url": f"jdbc:postgresql://{user[3]}" if user else url, "driver": "org.postgresql.Driver", "fetchsize": str(self.batch_size)}
        out |= {k: v for k, v in (("user", user[1]), ("password", user[2])) if v} if user else {}
        out |= {k: str(v) for k, v in self.partitioning.items()}
        return out | ({"query": self.query} if self.query else {"dbtable": self.table})

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).load()


@dataclass
class MongoSource(_Frame):
    """Needs the MongoDB connector for Spark; `_id` is dropped."""

    connection_string: str
    database: str
    collection: str
    query: dict | None = None
    projection: dict | None = None
    limit: int = 0

    def pipeline(self) -> list[dict]:
        stages = [{"$match": self.query}] if self.query else []
        stages += [{"$project": self.projection}] if self.projection else []
        return stages + ([{"$limit": self.limit}] if self.limit else [])

    def dataframe(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format("mongodb").option("connection.uri", self.connection_string).option("database", self.database).option("collection", self.collection)
        if stages := self.pipeline():
            reader = reader.option("aggregation.pipeline", json.dumps(stages))
        try:
            return reader.load().drop("_id")
        except Exception as e:
            if "mongodb" in str(e) and "DATA_SOURCE_NOT_FOUND" in str(e):
                raise SourceError("MongoSource needs the MongoDB connector for Spark on the classpath") from e
            raise


@dataclass
class KafkaSource(_Frame):
    """A bounded read from the earliest offset; payloads that are no JSON objects are skipped.  Needs Spark's Kafka connector."""

    bootstrap_servers: str
    topic: str
    group_id: str = "tessera"
    max_messages: int = 10_000
    timeout_seconds: float = 10.0
    consumer_config: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        own = {"kafka.bootstrap.servers": self.bootstrap_servers, "subscribe": self.topic, "startingOffsets": "earliest", "groupIdPrefix": self.group_id, "kafkaConsumer.pollTimeoutMs": str(int(self.timeout_seconds * 1000))}
        return own | {f"kafka.{k}": str(v) for k, v in self.consumer_config.items()}

    @staticmethod
    def objects(payloads: DataFrame) -> DataFrame:
        """JSON objects among payloads (a column `value`), as text."""
        text = payloads.select(F.col("value").cast("string").alias("value"))
        return text.where(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))

    def dataframe(self, spark: SparkSession) -> DataFrame:
        try:
            raw = spark.read.format("kafka").options(**self.options()).load()
        except Exception as e:
            if "kafka" in str(e).lower() and "find data source" in str(e).lower():
                raise SourceError("KafkaSource needs Spark's Kafka connector on the classpath") from e
            raise
        return self.objects(raw.limit(self.max_messages))

    def stream(self, spark: SparkSession) -> DataFrame:
        """The same as a stream."""
        return self.objects(spark.readStream.format("kafka").options(**self.options()).load())

    def read(self) -> Iterator[dict]:
        for row in self.dataframe(SparkSession.active()).toLocalIterator():
            yield json.loads(row.value)
