"""REST endpoints, page by page, as a Spark data source: each row is a record's JSON text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.connectors import _Frame

# Keys under which endpoints commonly put their records.
RECORD_KEYS = ("data", "results", "items", "records")


def with_params(url: str, params: dict[str, Any]) -> str:
    return url + ("&" if "?" in url else "?") + urlencode(params) if params else url


def records_of(payload: Any, data_key: str | None = None) -> list:
    """The records in a response: a list as it is, else what is under data_key, else under the first common key there is."""
    if isinstance(payload, list):
        return payload
    if not isinstance(payload, dict):
        return []
    keys = [data_key] if data_key else RECORD_KEYS
    return next((payload[k] for k in keys if isinstance(payload.get(k), list)), [])


@dataclass
class Pager:
    """Pages of an endpoint.  pagination: {"type": "page", page_param, size_param, page_size} or {"type": "cursor", cursor_key, cursor_param}; none: one page."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    data_key: str | None = None
    pagination: dict[str, Any] | None = None
    max_pages: int = 100

    def get(self, url: str) -> Any:
        with urlopen(Request(url, headers=self.headers), timeout=60) as response:  # noqa: S310
            return json.load(response)

    def page(self, number: int) -> list:
        p = self.pagination or {}
        size = {p["size_param"]: p.get("page_size", 100)} if p.get("size_param") else {}
        return records_of(self.get(with_params(self.url, {p.get("page_param", "page"): number} | size)), self.data_key)

    def pages(self) -> Iterator[list]:
        kind = (self.pagination or {}).get("type")
        cursor = None
        for number in range(1, self.max_pages + 1):
            if kind == "page":
                found, more = self.page(number), True
            else:
                p = self.pagination or {}
                payload = self.get(with_params(self.url, {p.get("cursor_param", "cursor"): cursor} if cursor else {}))
                found = records_of(payload, self.data_key)
                cursor = payload.get(p.get("cursor_key", "next_cursor")) if kind == "cursor" and isinstance(payload, dict) else None
                more = bool(cursor)
            if not found:
                return
            yield found
            if not more:
                return


class RESTReader(DataSourceReader):
    """One partition by default, as a cursor needs; with the option `pages` that many numbered pages, each a partition."""

    def __init__(self, options: dict[str, str]):
        self.pager = Pager(options["url"], json.loads(options.get("headers", "{}")), options.get("data_key"), json.loads(options.get("pagination", "null")), int(options.get("max_pages", "100")))
        self.fixed = int(options.get("pages", "0"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(1, self.fixed + 1)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in self.pager.pages() if partition.value is None else [self.pager.page(partition.value)]:
            for record in page:
                yield (json.dumps(record),)


class RESTDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_rest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return RESTReader(dict(self.options))


@dataclass
class RESTSource(_Frame):
    url: str
    headers: dict[str, str] | None = None
    data_key: str | None = None
    pagination: dict[str, Any] | None = None
    max_pages: int = 100
    pages: int = 0  # known number of numbered pages, read in parallel

    def dataframe(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(RESTDataSource)
        options = {"url": self.url, "headers": json.dumps(self.headers or {}), "max_pages": str(self.max_pages), "pages": str(self.pages)}
        options |= {"data_key": self.data_key} if self.data_key else {}
        options |= {"pagination": json.dumps(self.pagination)} if self.pagination else {}
        return spark.read.format("tessera_rest").options(**options).load()

    def read(self) -> Iterator[dict]:
        pager = Pager(self.url, self.headers or {}, self.data_key, self.pagination, self.max_pages)
        return (record for page in pager.pages() for record in page if isinstance(record, dict))
