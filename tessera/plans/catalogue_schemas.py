"""Queries over schemas, types, paths, DDL, sources, streams and commands: what the library tells about the test tables, against what DuckDB tells."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cli import main
from tessera.ddl import DIALECTS, DDLOptions, compile_ddl, compile_migration
from tessera.diff import diff
from tessera.functions import col, count_, if_, length, lit, star, sum_
from tessera.infer import infer
from tessera.normalize import normalize
from tessera.operators import Table
from tessera.pii.patterns import LOCALES, shapes
from tessera.plans.catalogue import customer_schemas, nested_orders
from tessera.plans.registry import dsl, frame, new_folder, table
from tessera.quality import generate_tests
from tessera.schema import Path, Schema
from tessera.sources import JSONSource, ParquetSource, RESTSource, Source
from tessera.sources.rest import records_of, with_params
from tessera.streaming import IncrementalInference
from tessera.streaming.incremental import windowed_counts
from tessera.types import FieldType, decode, encode
from tessera.types.lattice import join, meet, resolve_union, subsumes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: All columns of all tables, as the other engine describes them: tab, place, c, k (its type).
_DESCRIBED = " UNION ALL ".join(f"SELECT '{t}' AS tab, row_number() OVER () - 1 AS place, column_name AS c, column_type AS k FROM (DESCRIBE {t})" for t in TABLES)

# The other engine's types, and the library's names for them.
_NAMED = "(VALUES ('INTEGER', 'int32'), ('BIGINT', 'int64'), ('DOUBLE', 'float64'), ('FLOAT', 'float32'), ('VARCHAR', 'string'), ('TIMESTAMP', 'timestamp[us]'), ('FLOAT[]', 'list<float32>')) names(k, type)"


def _schemas(spark: SparkSession, sf_dir: str) -> Iterator[Schema]:
    for name in TABLES:
        yield Schema.from_spark(name, spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)


# --- types and schemas


@frame("schema_round_trip", f"SELECT tab, place, c AS field, type FROM ({_DESCRIBED}) JOIN {_NAMED} USING (k)")
def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through JSON, Arrow and Spark and back, every column keeps its name, place and type."""
    rows = []
    for s in _schemas(spark, sf_dir):
        back = Schema.from_json(json.loads(json.dumps(s.to_json())))
        back = Schema.from_spark(s.name, Schema.from_arrow(s.name, back.to_arrow()).to_spark())
        rows += [(back.name, i, n, encode(back.field(n).arrow_type)) for i, n in enumerate(back.field_names) if n in back]
    return spark.createDataFrame(rows, "tab string, place long, field string, type string")


_KEPT = f"SELECT 'new_' || tab AS tab, row_number() OVER (PARTITION BY tab ORDER BY place) - 1 AS place, c, k FROM ({_DESCRIBED}) WHERE c NOT LIKE '%key'"
_CHANGED = f"{_KEPT} UNION ALL SELECT 'new_' || tab, COUNT(*) FILTER (WHERE c NOT LIKE '%key'), 'extra', 'INTEGER' FROM ({_DESCRIBED}) GROUP BY tab"


@frame("schema_changes", f"SELECT tab, place, c AS field, type FROM ({_CHANGED}) JOIN {_NAMED} USING (k)")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in _schemas(spark, sf_dir):
        for n in s.field_names:
            s = s.drop_field(n) if n.endswith("key") else s
        s = s.add_field("extra", FieldType(pa.int32())).rename(f"new_{s.name}")
        rows += [(s.name, i, n, encode(t.arrow_type)) for i, (n, t) in enumerate(s.fields)]
    return spark.createDataFrame(rows, "tab string, place long, field string, type string")


_NODES = f"SELECT tab, c AS path, k FROM ({_DESCRIBED}) UNION ALL SELECT tab, c || '[]', k[:-3] FROM ({_DESCRIBED}) WHERE k LIKE '%[]'"


@frame("schema_walk", f"SELECT tab, path, type, k LIKE '%[]' AS is_array, type AS found FROM ({_NODES}) JOIN {_NAMED} USING (k)")
def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in _schemas(spark, sf_dir):
        arrays = {p for p, _ in s.walk_arrays()}
        rows += [(s.name, str(p), encode(t.arrow_type), p in arrays, encode(s.path(str(p)).arrow_type)) for p, t in s.walk()]
    return spark.createDataFrame(rows, "tab string, path string, type string, is_array boolean, found string")


@frame("path_algebra", f"SELECT tab || '.' || c || '[]' AS path, 3::BIGINT AS depth, tab || '.' || c AS parent, TRUE AS below, FALSE AS root FROM ({_DESCRIBED})")
def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in _schemas(spark, sf_dir):
        for n in s.field_names:
            p = Path.parse(str((Path() / s.name / n).array_element()))
            rows.append((str(p), p.depth, str(p.parent), p.is_descendant_of(Path.parse(s.name)), p.is_root()))
    return spark.createDataFrame(rows, "path string, depth long, parent string, below boolean, root boolean")


@frame("descriptor_evolve", f"SELECT tab, c AS field, k = 'VARCHAR' AS nullable, k LIKE '%[]' AS is_list, FALSE AS is_struct, FALSE AS is_union FROM ({_DESCRIBED})")
def _evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in _schemas(spark, sf_dir):
        for n, t in s.fields:
            t = t.evolve(null_ratio=0.5) if pa.types.is_string(t.arrow_type) else t
            rows.append((s.name, n, t.is_nullable, t.is_list, t.is_struct, t.is_union))
    return spark.createDataFrame(rows, "tab string, field string, nullable boolean, is_list boolean, is_struct boolean, is_union boolean")


_SCALARS = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "decimal128(38,18)", "bool", "string", "date32", "timestamp[us]")
_RANKED = "(VALUES ('int8', 'i', 1), ('int16', 'i', 2), ('int32', 'i', 3), ('int64', 'i', 4), ('uint8', 'u', 1), ('uint16', 'u', 2), ('uint32', 'u', 3), ('uint64', 'u', 4), ('float16', 'f', 2), ('float32', 'f', 3), ('float64', 'f', 4), ('decimal128(38,18)', 'd', 0), ('bool', 'b', 0), ('string', 's', 0), ('date32', 'day', 0), ('timestamp[us]', 'time', 0))"


@frame("lattice_pairs", f"""
WITH pair AS (SELECT x.t AS a, x.f AS fa, x.r AS ra, y.t AS b, y.f AS fb, y.r AS rb, x.f IN ('i', 'u', 'f', 'd') AND y.f IN ('i', 'u', 'f', 'd') AS numbers FROM {_RANKED} x(t, f, r), {_RANKED} y(t, f, r))
SELECT a, b,
  CASE WHEN fa = fb THEN CASE WHEN ra >= rb THEN a ELSE b END WHEN numbers AND 'd' IN (fa, fb) THEN 'decimal128(38,18)' WHEN numbers AND 'f' IN (fa, fb) THEN 'float64' WHEN numbers THEN 'int64'
    WHEN fa = 'time' AND fb = 'day' THEN a WHEN fa = 'day' AND fb = 'time' THEN b ELSE 'string' END AS joined,
  fa <> fb AND NOT numbers AND 's' NOT IN (fa, fb) AND NOT (fa IN ('day', 'time') AND fb IN ('day', 'time')) AS is_union,
  CASE WHEN fa = fb THEN CASE WHEN ra <= rb THEN a ELSE b END WHEN fa = 's' THEN b WHEN fb = 's' THEN a ELSE 'null' END AS met,
  CASE WHEN fa = 's' THEN TRUE WHEN fa = fb THEN ra >= rb WHEN fa = 'i' AND fb = 'u' THEN ra > rb WHEN a = 'float64' AND fb IN ('i', 'u') THEN TRUE WHEN fa = 'd' THEN numbers ELSE fa = 'time' AND fb = 'day' END AS holds
FROM pair""")
def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for a, x in ((n, FieldType(decode(n))) for n in _SCALARS):
        for b, y in ((n, FieldType(decode(n))) for n in _SCALARS):
            up = join(x, y)
            rows.append((a, b, encode(resolve_union(up).arrow_type), up.is_union, encode(meet(x, y).arrow_type), subsumes(x, y)))
    return spark.createDataFrame(rows, "a string, b string, joined string, is_union boolean, met string, holds boolean")


@frame("pii_pattern_sets", "SELECT * FROM (VALUES ('common', 6), ('in', 11), ('us', 9), ('eu', 10), ('all', 18), ('unknown', 6)) v(locale, n)")
def _pattern_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(name, len(shapes(name))) for name in (*LOCALES, "all", "unknown")], "locale string, n int")


# --- changes and DDL


def _versions(s: Schema) -> tuple[Schema, Schema]:
    """The schema, and a later version with wider integers and a new column that may be null."""
    wider = tuple((n, t.evolve(arrow_type=pa.int64()) if t.arrow_type == pa.int32() else t) for n, t in s.fields)
    return s, Schema(s.name, wider).add_field("note", FieldType(pa.string(), null_ratio=0.5))


@frame("schema_diff_summary", f"SELECT tab, COUNT(*) FILTER (WHERE k = 'INTEGER') + 1 AS safe, COUNT(*) FILTER (WHERE k = 'INTEGER') AS back_risky, 1::BIGINT AS back_breaking, 1::BIGINT AS added, TRUE AS breaks FROM ({_DESCRIBED}) GROUP BY tab")
def _diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in _schemas(spark, sf_dir):
        old, new = _versions(s)
        there, back = diff(old, new), diff(new, old)
        assert not there.has_risky_changes and not diff(old, old)
        rows.append((s.name, there.summary()["safe"], len(back.filter("risky")), back.summary()["breaking"], len(there.filter_kind("added")), back.has_breaking_changes))
    return spark.createDataFrame(rows, "tab string, safe long, back_risky long, back_breaking long, added long, breaks boolean")


# How each dialect writes the types of the test tables, quotes names, says that a column has no nulls, ends a table and changes a type.
_WRITTEN = {
    "duckdb": ("INTEGER", "BIGINT", "DOUBLE", "VARCHAR", "TIMESTAMP", "FLOAT[]", '"', " NOT NULL", "", "SET DATA TYPE"),
    "postgres": ("INTEGER", "BIGINT", "DOUBLE PRECISION", "VARCHAR", "TIMESTAMP", "REAL[]", '"', " NOT NULL", "", "TYPE"),
    "redshift": ("INTEGER", "BIGINT", "DOUBLE PRECISION", "VARCHAR(65535)", "TIMESTAMP", "SUPER", '"', " NOT NULL", "", "TYPE"),
    "bigquery": ("INT64", "INT64", "FLOAT64", "STRING", "TIMESTAMP", "ARRAY<FLOAT64>", "`", "", "", "SET DATA TYPE"),
    "snowflake": ("NUMBER(10,0)", "NUMBER(19,0)", "FLOAT", "VARCHAR", "TIMESTAMP_NTZ", "ARRAY", '"', " NOT NULL", "", "SET DATA TYPE"),
    "databricks": ("INT", "BIGINT", "DOUBLE", "STRING", "TIMESTAMP", "ARRAY<FLOAT>", "`", " NOT NULL", "\nUSING DELTA", "TYPE"),
}
_KINDS = ("INTEGER", "BIGINT", "DOUBLE", "VARCHAR", "TIMESTAMP", "FLOAT[]")
_DIALECT_TYPES = "(VALUES " + ", ".join(f"('{d}', '{k}', '{t}')" for d, w in _WRITTEN.items() for k, t in zip(_KINDS, w)) + ") types(dialect, k, type)"
_DIALECT_WORDS = "(VALUES " + ", ".join(f"('{d}', '{w[6]}', '{w[7]}', '{w[8]}', '{w[9]}')" for d, w in _WRITTEN.items()) + ") words(dialect, q, no_nulls, tail, alter)"
_CREATED = f"SELECT dialect, tab, 'CREATE TABLE IF NOT EXISTS ' || q || 's' || q || '.' || q || tab || q || ' (\n' || string_agg('  ' || q || c || q || ' ' || type || no_nulls, ',\n' ORDER BY place) || '\n)' || tail || ';' AS statement FROM ({_DESCRIBED}) JOIN {_DIALECT_TYPES} USING (k) JOIN {_DIALECT_WORDS} USING (dialect) GROUP BY dialect, tab, q, tail"


@frame("ddl_tables", _CREATED)
def _ddl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = DDLOptions(if_not_exists=True, schema_prefix="s")
    rows = [(d, s.name, compile_ddl(s, d, options).to_sql()) for s in _schemas(spark, sf_dir) for d in _WRITTEN]
    return spark.createDataFrame(rows, "dialect string, tab string, statement string")


_ALTERED = f"""
WITH wide AS (SELECT dialect, type FROM {_DIALECT_TYPES} WHERE k = 'BIGINT'), texts AS (SELECT dialect, type FROM {_DIALECT_TYPES} WHERE k = 'VARCHAR')
SELECT dialect, tab, 'ALTER TABLE ' || q || tab || q || ' ALTER COLUMN ' || q || c || q || ' ' || alter || ' ' || type || ';' AS statement FROM ({_DESCRIBED}), {_DIALECT_WORDS} JOIN wide USING (dialect) WHERE k = 'INTEGER'
UNION ALL SELECT dialect, tab, 'ALTER TABLE ' || q || tab || q || ' ADD COLUMN ' || q || 'note' || q || ' ' || type || ';' FROM (SELECT DISTINCT tab FROM ({_DESCRIBED})), {_DIALECT_WORDS} JOIN texts USING (dialect)"""


@frame("ddl_migrations", _ALTERED)
def _ddl_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(d, s.name, x) for s in _schemas(spark, sf_dir) for d in _WRITTEN for x in compile_migration(diff(*_versions(s)), d).statements]
    return spark.createDataFrame(rows, "dialect string, tab string, statement string")


# How each dialect writes a struct, and notes on columns; whether it has primary keys, and foreign keys that are added later.
_STRUCT = """('duckdb', 'PLACE', 'STRUCT("nation" INTEGER, "segment" VARCHAR)'), ('postgres', 'PLACE', 'JSONB'), ('redshift', 'PLACE', 'SUPER'), ('bigquery', 'PLACE', 'STRUCT<nation INT64, segment STRING>'), ('snowflake', 'PLACE', 'OBJECT'), ('databricks', 'PLACE', 'STRUCT<`nation`: INT, `segment`: STRING>')"""
_KEYS = "('duckdb', 'dash', TRUE, FALSE), ('postgres', 'dash', TRUE, TRUE), ('redshift', 'dash', TRUE, TRUE), ('bigquery', 'options', FALSE, FALSE), ('snowflake', 'comment', TRUE, TRUE), ('databricks', 'comment', FALSE, FALSE)"

_PLANNED = f"""
WITH cols(tab, place, c, k, note) AS (VALUES ('orders', 0, '__id', 'VARCHAR', 'surrogate key'), ('orders', 1, 'o_orderkey', 'BIGINT', NULL), ('orders', 2, 'o_totalprice', 'DOUBLE', NULL), ('orders', 3, 'customer__name', 'VARCHAR', NULL), ('orders', 4, 'customer__place', 'PLACE', NULL),
  ('orders__items', 0, '__id', 'VARCHAR', 'surrogate key'), ('orders__items', 1, '__parent_id', 'VARCHAR', 'key of orders'), ('orders__items', 2, '__ordinal', 'BIGINT', 'place in the list'), ('orders__items', 3, 'line', 'INTEGER', NULL), ('orders__items', 4, 'part', 'BIGINT', NULL), ('orders__items', 5, 'qty', 'DOUBLE', NULL)),
kinds(dialect, k, type) AS (SELECT * FROM {_DIALECT_TYPES} UNION ALL VALUES {_STRUCT}),
w AS (SELECT * FROM {_DIALECT_WORDS} JOIN (VALUES {_KEYS}) v(dialect, notes, keyed, linked) USING (dialect)),
lines AS (SELECT dialect, tab, place, '  ' || q || c || q || ' ' || type || no_nulls
    || CASE WHEN note IS NULL OR notes = 'dash' THEN '' WHEN notes = 'options' THEN ' OPTIONS(description=''' || note || ''')' ELSE ' COMMENT ''' || note || '''' END
    || CASE WHEN keyed OR place < MAX(place) OVER (PARTITION BY dialect, tab) THEN ',' ELSE '' END || CASE WHEN notes = 'dash' AND note IS NOT NULL THEN ' -- ' || note ELSE '' END AS line
  FROM cols JOIN kinds USING (k) JOIN w USING (dialect)),
made AS (
  SELECT dialect, CASE tab WHEN 'orders' THEN 0 ELSE 1 END AS place, 'CREATE TABLE ' || q || tab || q || ' (\n' || string_agg(line, '\n' ORDER BY lines.place) || CASE WHEN keyed THEN '\n  PRIMARY KEY (' || q || '__id' || q || ')' ELSE '' END || '\n)' || tail || ';' AS statement
    FROM lines JOIN w USING (dialect) GROUP BY dialect, tab, q, keyed, tail
  UNION ALL SELECT dialect, 2, 'ALTER TABLE "orders__items" ADD FOREIGN KEY ("__parent_id") REFERENCES "orders" ("__id");' FROM w WHERE linked
  UNION ALL SELECT dialect, p, 'ALTER TABLE ' || q || 'customer' || q || ' ALTER COLUMN ' || q || c || q || ' ' || alter || ' ' || type || ';' FROM w JOIN kinds USING (dialect), (VALUES (100, 'id'), (101, 'name')) v(p, c) WHERE k = 'BIGINT'
  UNION ALL SELECT dialect, p, x FROM w, (VALUES (102, '-- risky: field ''age'' became non-nullable'), (103, '-- skipped, breaking: field ''gone'' removed')) v(p, x)
  UNION ALL SELECT dialect, 104, 'ALTER TABLE ' || q || 'customer' || q || ' ADD COLUMN ' || q || 'email' || q || ' ' || type || ';' FROM w JOIN kinds USING (dialect) WHERE k = 'VARCHAR')
SELECT dialect, place, statement FROM made UNION ALL SELECT 'postgresql', place, statement FROM made WHERE dialect = 'postgres'
"""


@frame("ddl_rows", _PLANNED)
def _ddl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = normalize(Schema.from_spark("orders", nested_orders(spark, sf_dir).schema))
    rows = [(name, i, s) for name in DIALECTS for i, s in enumerate(compile_ddl(plan, name).statements)]
    rows += [(name, 100 + i, s) for name in DIALECTS for i, s in enumerate(compile_migration(diff(*customer_schemas()), name, skip_breaking=True).statements)]
    return spark.createDataFrame(rows, "dialect string, place int, statement string")


# --- sources


def _json_of(t: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.to_json(F.struct("*")).alias("value"))


@frame("source_json_lines", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as lines of JSON, read back with the schema that the table has."""
    path = new_folder(spark, "customer")
    _json_of("customer", spark, sf_dir).write.text(path)
    return JSONSource(path, "ndjson").parsed(spark, spark.read.parquet(f"{sf_dir}/customer.parquet").schema)


@frame("source_json_whole", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _json_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as files that are a list of objects each, one per region."""
    path, nation = new_folder(spark, "nation"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    lists = nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    lists.withColumn("part", F.col("n_regionkey")).select("part", "value").write.partitionBy("part").text(path)
    return JSONSource(f"{path}/*").dataframe(spark).select(F.from_json("value", nation.schema).alias("x")).select("x.*")


@frame("source_parquet", f"SELECT tab, c AS field, type, TRUE AS is_source FROM ({_DESCRIBED}) JOIN {_NAMED} USING (k)")
def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in TABLES:
        source = ParquetSource(f"{sf_dir}/{name}.parquet")
        rows += [(name, f.name, encode(f.type), isinstance(source, Source)) for f in source.schema_hint()["arrow_schema"]]
    return spark.createDataFrame(rows, "tab string, field string, type string, is_source boolean")


@frame("source_rest", "SELECT n_nationkey, n_name, n_regionkey, '/nation?v=1&page=' || (n_nationkey // 10 + 1) AS url FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, '/nation?cursor=' FROM nation")
def _rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, ten to a page, served by number and by cursor; every row says where it came from."""
    nations = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows at every size

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            asked = parse_qs(urlparse(self.path).query)
            page = int(asked.get("page", asked.get("cursor", ["1"]))[0])
            url = self.path if "page" in asked else "/nation?cursor="
            found = [{**n, "url": url} for n in nations[page * 10 - 10 : page * 10]]
            out = json.dumps({"results": found, "next_cursor": page + 1 if page * 10 < len(nations) else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args) -> None:
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}/nation"
        rows = [*RESTSource(with_params(at, {"v": 1}), pagination={"type": "page", "page_param": "page"}).read(), *RESTSource(at, pagination={"type": "cursor"}).read()]
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], r["n_regionkey"], r["url"]) for r in rows], "n_nationkey int, n_name string, n_regionkey int, url string")


@frame("rest_records", "SELECT how, n_nationkey, n_name FROM nation, (VALUES ('list'), ('data'), ('results'), ('items'), ('records'), ('own')) v(how)")
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]  # 25 rows at every size
    payloads = {"list": rows, **{k: {k: rows, "n": len(rows)} for k in ("data", "results", "items", "records")}, "own": {"own": rows, "data": []}}
    found = [(how, r["n_nationkey"], r["n_name"]) for how, p in payloads.items() for r in records_of(p, "own" if how == "own" else None)]
    return spark.createDataFrame(found, "how string, n_nationkey int, n_name string")


# --- table expressions by name, as text, and with all columns


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    view = f"tessera_{name}"
    spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
    return view


def _by_segment(customer: Table, orders: Table) -> Table:
    joined = customer.join(orders.filter(col("o_orderpriority").like("1%")), col("c_custkey", "_left") == col("o_custkey", "_right"))
    return joined.group_by("c_mktsegment").agg(count_().alias("n"), sum_(if_(col("o_orderstatus") == "F", 1, 0)).alias("done")).filter(col("n") > 1).sort(col("n").desc())


_SEGMENTS = "SELECT c_mktsegment, COUNT(*) AS n, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority LIKE '1%' GROUP BY c_mktsegment HAVING COUNT(*) > 1"


@frame("emitted_sql", _SEGMENTS)
def _emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression's own SQL, run as text."""
    tables = (Table(_view(spark, sf_dir, t), Schema.from_spark(t, spark.read.parquet(f"{sf_dir}/{t}.parquet").schema)) for t in ("customer", "orders"))
    return spark.sql(_by_segment(*tables).to_sql("databricks"))


@frame("raw_sql_node", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 3")
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.from_sql(f"SELECT o_custkey, COUNT(*) AS n FROM {_view(spark, sf_dir, 'orders')} GROUP BY o_custkey").filter(col("n") > 3).dataframe(spark)


dsl("star_columns", "SELECT *, p_size * 2 AS twice FROM part WHERE p_size > 5", "part")(lambda t: t.filter(col("p_size") > 5).select(star(), (col("p_size") * 2).alias("twice")))
dsl("literal_kinds", "SELECT r_regionkey, 1 AS i, 2.5::DOUBLE AS f, 'it''s' AS s, TRUE AS b, NULL::VARCHAR AS z, LENGTH(r_name) AS n FROM region", "region")(lambda t: t.select(col("r_regionkey"), lit(1).alias("i"), lit(2.5).alias("f"), lit("it's").alias("s"), lit(True).alias("b"), lit(None).cast("VARCHAR").alias("z"), length("r_name").alias("n")))


@frame("current_columns", "SELECT row_number() OVER () - 1 AS place, column_name AS field FROM (DESCRIBE SELECT * EXCLUDE (o_orderstatus) RENAME (o_custkey AS o_cust), 1 AS extra FROM orders)")
def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").drop("o_orderstatus").rename(o_custkey="o_cust").with_column("extra", lit(1))
    return spark.createDataFrame(list(enumerate(t.columns)), "place long, field string")


# --- inference from a sample and from a stream


def _inferred(spark: SparkSession, schema: Schema) -> DataFrame:
    return spark.createDataFrame([(n, encode(t.arrow_type), t.sample_count) for n, t in schema.fields], "field string, type string, n long")


@frame("infer_sample", "SELECT 'k' AS field, 'int64' AS type, LEAST(COUNT(*), 2000) AS n FROM events")
def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, infer(spark.read.parquet(f"{sf_dir}/events.parquet").select("props"), sample_size=2000, seed=7))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/event[s].parquet")


@frame("stream_inference", "SELECT 'k' AS field, 'int64' AS type, COUNT(*) AS n FROM events")
def _stream_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stream")
    seen = IncrementalInference(f"{path}/seen", "props")
    seen.start(_stream(spark, sf_dir).select("props"), f"{path}/checkpoint").awaitTermination()
    return _inferred(spark, seen.schema(spark))


@frame("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def _stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows so far, a table per micro-batch, of which the last is whole."""
    path = new_folder(spark, "counts")
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    counts = windowed_counts(_stream(spark, sf_dir), "ts", ["event_type"])
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/batch={last[0]}")


# --- commands


def _run(*argv: str) -> tuple[int, str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = main(list(argv))
    return code, out.getvalue().strip()


@frame("cli_commands", f"""
WITH d AS ({_DESCRIBED}), t AS (SELECT tab, COUNT(*) AS n, COUNT(*) FILTER (WHERE k = 'INTEGER') AS ints, COUNT(*) FILTER (WHERE k LIKE '%[]') AS lists FROM d GROUP BY tab)
SELECT 'ddl' AS command, tab, 0 AS code, n + 2 AS lines FROM t UNION ALL SELECT 'diff', tab, 0, ints + 1 FROM t UNION ALL SELECT 'diff back', tab, 1, ints + 1 FROM t
UNION ALL SELECT 'test', tab, 0, n FROM t UNION ALL SELECT 'lineage', tab, 0, lists FROM t UNION ALL SELECT 'normalize', tab, 0, lists + 1 FROM t""")
def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each command says of each table: lines of a statement or report, tests, edges, tables."""
    rows = []
    with tempfile.TemporaryDirectory() as own:  # read and written by this process alone

        def put(name: str, schema: Schema) -> str:
            path = os.path.join(own, name)
            with open(path, "w") as f:
                json.dump(schema.to_json(), f)
            return path

        for s in _schemas(spark, sf_dir):
            s = Schema(s.name, tuple((n, t.evolve(sample_count=10)) for n, t in s.fields))
            old, new = (put(n, v) for n, v in zip(("old", "new"), _versions(s)))
            said = {"ddl": _run("ddl", old), "diff": _run("diff", old, new), "diff back": _run("diff", new, old), "test": _run("test", old), "lineage": _run("lineage", old), "normalize": _run("normalize", old)}
            how = {"test": lambda x: len(json.loads(x)), "lineage": lambda x: x.count("->"), "normalize": lambda x: x.count("CREATE TABLE")}
            rows += [(c, s.name, code, how.get(c, lambda x: len(x.splitlines()))(text)) for c, (code, text) in said.items()]
    return spark.createDataFrame(rows, "command string, tab string, code int, lines long")


@frame("generated_tests", f"SELECT tab, c AS field, 'not_null' AS kind FROM ({_DESCRIBED})")
def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for s in _schemas(spark, sf_dir):
        s = Schema(s.name, tuple((n, t.evolve(sample_count=10)) for n, t in s.fields))
        rows += [(s.name, str(t.path), t.kind) for t in generate_tests(s)]
    return spark.createDataFrame(rows, "tab string, field string, kind string")


@frame("normalized_columns", f"SELECT tab AS table_name, c AS column_name FROM ({_DESCRIBED}) WHERE k NOT LIKE '%[]' UNION ALL SELECT tab, '__id' FROM ({_DESCRIBED}) GROUP BY tab UNION ALL SELECT tab || '__' || c, unnest(['__id', '__parent_id', '__ordinal', 'value']) FROM ({_DESCRIBED}) WHERE k LIKE '%[]'")
def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t.name, n) for s in _schemas(spark, sf_dir) for t in normalize(s).tables for n in t.field_names]
    return spark.createDataFrame(rows, "table_name string, column_name string")
