import json

import duckdb
import pyarrow as pa
import pytest

from tessera import infer, normalize
from tessera.ddl import DIALECTS, DDLOptions, compile_ddl, compile_migration
from tessera.diff import diff
from tessera.errors import DDLCompilationError, NormalizationError
from tessera.normalize import ForeignKey
from tessera.schema import Schema
from tessera.types import FieldType

DOCS = [{"id": i, "who": {"name": f"n{i}", "at": {"city": "c"}}, "items": [{"sku": f"s{j}", "tags": ["x"] * j} for j in range(i)], "codes": [i, i + 1]} for i in range(4)]


@pytest.fixture
def frame(spark):
    schema = infer(DOCS, name="orders", detect_pii=False)
    return schema, spark.read.schema(schema.to_spark()).json(spark.sparkContext.parallelize([json.dumps(d) for d in DOCS]))


def test_first_normal_form():
    plan = normalize(infer(DOCS, name="orders"))
    assert plan.table_names() == ["orders", "orders__items", "orders__items__tags", "orders__codes"]
    assert plan.root_table.field_names == ["__id", "id", "who__name", "who__at"]
    assert plan.get_table("orders__codes").field_names == ["__id", "__parent_id", "__ordinal", "value"]
    assert plan.foreign_keys[-1] == ForeignKey("orders__codes", "__parent_id", "orders", "__id")
    assert [e.transform for e in plan.lineage.all_edges()] == ["flatten", "flatten", "extract_array", "extract_array", "extract_array"]


def test_other_strategies():
    schema = infer(DOCS, name="o")
    assert [t.semantic for _, t in normalize(schema, "mongo").root_table.fields if t.semantic] == ["json_blob"] * 3
    small = Schema("t", (("tags", FieldType(pa.list_(pa.string()), cardinality_estimate=3)), ("many", FieldType(pa.list_(pa.string()), cardinality_estimate=30))))
    assert normalize(small, "inline_small").table_names() == ["t", "t__many"]
    assert normalize(small, "custom").table_names() == normalize(small).table_names()
    assert normalize(schema, recursive=True).root_table.field_names[-1] == "who__at__city"


def test_shredding_puts_rows_together_again(frame):
    schema, df = frame
    tables = {n: [r.asDict(recursive=True) for r in t.collect()] for n, t in normalize(schema).apply(df, keys=["id"]).items()}
    root = {r["__id"]: r for r in tables["orders"]}
    assert len(root) == 4
    for doc in DOCS:
        key = next(k for k, r in root.items() if r["id"] == doc["id"])
        items = sorted((r for r in tables["orders__items"] if r["__parent_id"] == key), key=lambda r: r["__ordinal"])
        assert [r["sku"] for r in items] == [i["sku"] for i in doc["items"]] and [r["__ordinal"] for r in items] == list(range(len(items)))
        assert [sum(t["__parent_id"] == r["__id"] for t in tables["orders__items__tags"]) for r in items] == [len(i["tags"]) for i in doc["items"]]
        assert sorted(r["value"] for r in tables["orders__codes"] if r["__parent_id"] == key) == doc["codes"]


def test_keys_are_stable_and_unique(spark, frame):
    schema, df = frame
    plan = normalize(schema)
    twice = df.union(df)
    a, b = ({r["__id"] for r in plan.apply(f)["orders"].collect()} for f in (twice, twice.repartition(3)))
    assert len(a) == 8 and a == b
    with pytest.raises(NormalizationError):
        plan.apply(spark.range(2))


@pytest.mark.parametrize("strategy", ["1nf", "mongo"])
def test_duckdb_runs_the_tables(strategy):
    con = duckdb.connect()
    con.execute(compile_ddl(normalize(infer(DOCS, name="o"), strategy), "duckdb").to_sql())
    assert con.sql("SELECT count(*) FROM duckdb_tables()").fetchall()[0][0] == (4 if strategy == "1nf" else 1)


def test_spark_runs_databricks_columns(spark):
    script = compile_ddl(infer(DOCS, name="dbx"), "databricks").to_sql().replace("USING DELTA", "USING parquet")
    spark.sql("DROP TABLE IF EXISTS dbx")
    spark.sql(script.rstrip(";"))
    assert spark.table("dbx").columns == ["id", "who", "items", "codes"]


TYPES = Schema("t", (
    ("ok", FieldType(pa.bool_())), ("n", FieldType(pa.int64(), null_ratio=0.1)), ("f", FieldType(pa.float64())), ("s", FieldType(pa.string(), description="it's, so")),
    ("at", FieldType(pa.timestamp("us"))), ("atz", FieldType(pa.timestamp("us", "UTC"))), ("d", FieldType(pa.decimal128(10, 2))), ("l", FieldType(pa.list_(pa.int32()))),
    ("st", FieldType(pa.struct([("a", pa.int64())]))), ("j", FieldType(pa.string(), semantic="json_blob")), ("u", FieldType(pa.uint32())), ("x", FieldType(pa.duration("us"))),
))


@pytest.mark.parametrize(
    ("dialect", "parts"),
    [
        ("duckdb", ['"n" BIGINT NULL', '"l" INTEGER[] NOT NULL', 'STRUCT("a" BIGINT)', '"j" JSON', '"u" UINTEGER', "DECIMAL(10,2)", "NOT NULL, -- it's, so"]),
        ("postgres", ['"st" JSONB', '"atz" TIMESTAMPTZ', '"f" DOUBLE PRECISION', '"l" INTEGER[]']),
        ("redshift", ['"s" VARCHAR(65535)', '"l" SUPER']),
        ("bigquery", ["`ok` BOOL,", "`l` ARRAY<INT64>", "STRUCT<a INT64>", "OPTIONS(description='it''s, so')", "`x` STRING"]),
        ("snowflake", ['"at" TIMESTAMP_NTZ NOT NULL', '"atz" TIMESTAMP_TZ', '"n" NUMBER(19,0),', "COMMENT 'it''s, so'", '"st" OBJECT']),
        ("databricks", ["`l` ARRAY<INT>", "STRUCT<`a`: BIGINT>", "USING DELTA", "`u` BIGINT"]),
    ],
)
def test_types_by_dialect(dialect, parts):
    sql = compile_ddl(TYPES, dialect).to_sql()
    for p in parts:
        assert p in sql, sql


def test_table_options():
    def made(dialect, **o):
        return compile_ddl(TYPES, dialect, DDLOptions(if_not_exists=True, schema_prefix="raw", extra_options=o)).to_sql()

    assert 'CREATE TABLE IF NOT EXISTS "raw"."t"' in made("postgres")
    assert 'DISTKEY("n")' in made("redshift", distkey="n") and 'COMPOUND SORTKEY("n", "f")' in made("redshift", sortkey=["n", "f"])
    assert "PARTITION BY DATE(`at`)" in made("bigquery", partition_by="at") and "CLUSTER BY `n`" in made("bigquery", cluster_by="n")
    assert "PARTITIONED BY (`n`)" in made("databricks", partition_by="n")
    assert "--" not in compile_ddl(TYPES, "duckdb", DDLOptions(include_comments=False)).to_sql()


def test_foreign_keys_where_they_can_be_added():
    plan = normalize(infer(DOCS, name="o"))
    for name in DIALECTS:
        assert ("FOREIGN KEY" in str(compile_ddl(plan, name, DDLOptions(schema_prefix="raw")))) is (name in ("postgres", "postgresql", "redshift", "snowflake"))
    assert '"raw"."o__items" ADD FOREIGN KEY' in str(compile_ddl(plan, "postgres", DDLOptions(schema_prefix="raw")))


def test_unknown_dialect_and_input():
    for bad in (lambda: compile_ddl(TYPES, "oracle"), lambda: compile_ddl("x", "duckdb")):
        with pytest.raises(DDLCompilationError):
            bad()


OLD = Schema("c", (("id", FieldType(pa.int32())), ("age", FieldType(pa.int64())), ("s", FieldType(pa.string()))))
NEW = Schema("c", (("id", FieldType(pa.int64())), ("age", FieldType(pa.int64(), null_ratio=0.2)), ("s", FieldType(pa.string(), pii_class="email", semantic="enum")), ("b", FieldType(pa.bool_(), null_ratio=1.0))))


def test_diff_kinds():
    d = diff(OLD, NEW)
    assert [(str(c.path), c.kind, c.severity) for c in d.changes] == [("id", "type_changed", "safe"), ("age", "nullable_changed", "safe"), ("s", "semantic_changed", "risky"), ("s", "pii_changed", "risky"), ("b", "added", "safe")]
    back = diff(NEW, OLD)
    assert back.has_breaking_changes and len(back.filter("breaking")) == 1 and len(back.filter_kind("removed")) == 1
    assert d.summary() == {"safe": 3, "risky": 2, "breaking": 0} and d.has_risky_changes and not d.has_breaking_changes and not diff(OLD, OLD)
    assert diff(Schema("a", (("x", FieldType(pa.int64())),)), Schema("a", (("x", FieldType(pa.bool_())),))).changes[0].severity == "breaking"


def test_struct_changes():
    a = Schema("t", (("s", FieldType(pa.struct([("a", pa.int64())]))),))
    b = Schema("t", (("s", FieldType(pa.struct([("a", pa.int64()), ("b", pa.string())]))),))
    assert diff(a, b).has_breaking_changes and diff(a, b, structs=True).summary()["safe"] == 1


def test_migrations_run():
    con = duckdb.connect()
    con.execute(compile_ddl(OLD, "duckdb").to_sql())
    con.execute(compile_migration(diff(OLD, NEW), "duckdb").to_sql())
    assert con.sql("SELECT data_type FROM duckdb_columns() WHERE column_name IN ('id', 'b') ORDER BY 1").fetchall() == [("BIGINT",), ("BOOLEAN",)]
    with pytest.raises(DDLCompilationError):
        compile_migration(diff(NEW, OLD))
    assert "-- skipped, breaking" in compile_migration(diff(NEW, OLD), "postgres", skip_breaking=True).to_sql()
