import datetime
import math

import pytest

from tessera.errors import PlanError
from tessera.functions import avg_, call, coalesce, col, concat, count_, count_distinct_, date_trunc, if_, length, lit, max_, star, sum_
from tessera.operators import Table
from tests.conftest import DATA

NAMED = {
    "chained filters": lambda t: t("orders").filter(col("o_totalprice") > 1000).filter(col("o_orderstatus") == "F").select("o_orderkey"),
    "filter on a union": lambda t: t("region").union(t("region")).filter(col("r_regionkey") > 1),
    "bare scan": lambda t: t("region"),
    "bare distinct": lambda t: t("nation").distinct(),
    "shadowed alias": lambda t: t("part").select(col("p_partkey"), (col("p_size") * 2).alias("p_size")).filter(col("p_size") > 60),
    "nested projects": lambda t: t("part").select((col("p_size") + 1).alias("a")).select((col("a") * 2).alias("b")).filter(col("b") > 20),
    "having": lambda t: t("orders").group_by(col("o_custkey").alias("k")).agg(count_().alias("n"), max_("o_totalprice").alias("m")).filter(col("n") > 8),
    "replace": lambda t: t("nation").with_column("n_name", col("n_name").lower()).rename(n_nationkey="k").drop("n_regionkey"),
    "order and offset": lambda t: t("customer").sort(col("c_acctbal").desc(), "c_custkey").limit(7, offset=3).select("c_custkey"),
    "join and suffix": lambda t: t("nation").join(t("nation"), "n_regionkey").select("n_name", "n_name_1"),
    "semi": lambda t: t("customer").join(t("orders"), col("c_custkey", "_left") == col("o_custkey", "_right"), "left semi").select("c_custkey"),
    "anti": lambda t: t("orders").join(t("lineitem"), col("o_orderkey", "_left") == col("l_orderkey", "_right"), "anti").select("o_orderkey"),
    "cross": lambda t: t("region").join(t("region"), how="cross"),
    "text": lambda t: t("part").select(col("p_name").upper().alias("u"), concat(col("p_brand"), None, "x").alias("c"), length("p_type").alias("n")).filter(col("u").startswith("S") & col("u").endswith("G") & col("u").contains("L")),
    "like": lambda t: t("part").filter(col("p_brand").like("Brand#_") | col("p_type").ilike("%eco%")).select("p_partkey"),
    "dates": lambda t: t("orders").with_column("m", date_trunc("year", "o_orderdate")).group_by("m").agg(count_().alias("n")),
    "null tests": lambda t: t("orders").select(coalesce(if_(col("o_orderstatus") == "O", None, col("o_orderstatus")), "-").alias("s"), col("o_orderkey").in_([]).alias("never")).filter(col("s").is_not_null() & ~col("never")).group_by("s").agg(count_().alias("n")),
    "aggregates": lambda t: t("lineitem").select(count_distinct_("l_suppkey").alias("d"), sum_("l_quantity").alias("q"), avg_("l_quantity").alias("a")).filter(col("q") > 0),
    "windows": lambda t: t("orders").window("o_custkey", [col("o_orderdate"), col("o_orderkey")]).over(call("row_number").alias("r")).filter(col("r") == 1).select("o_orderkey"),
    "by name": lambda t: t("region").union(t("nation").select(col("n_name").alias("r_name"), col("n_nationkey").alias("r_regionkey")), by_name=True),
    "division": lambda t: t("part").select(col("p_partkey"), (col("p_size") / (col("p_partkey") - 3)).alias("r")),
}


def rows(found):
    return sorted(str([None if v is None else v if not isinstance(v, float) else "nan" if math.isnan(v) else round(v, 6) for v in r]) for r in found)


@pytest.mark.parametrize("name", NAMED)
def test_sql_and_dataframe_agree(name, spark, duck):
    from tessera.sources import ParquetSource

    columns = {n: spark.read.parquet(f"{DATA}/{n}.parquet").columns for n in ("region", "nation", "customer", "part", "orders", "lineitem")}

    class Known:
        def __init__(self, n):
            self.names = columns[n]

    q = NAMED[name]
    ours = q(lambda n: Table.from_source(ParquetSource(f"{DATA}/{n}.parquet"), spark)).dataframe(spark)
    text = q(lambda n: Table(n, schema=Known(n))).to_sql("duckdb")
    found = duck.sql(text)
    assert found.columns == ours.columns
    assert rows(map(tuple, ours.collect())) == rows(found.fetchall())
    assert ours.count() > 0


def test_unknown_columns_still_render(duck):
    t = Table("nation").with_column("x", lit(1)).drop("n_regionkey").rename(n_name="n")
    assert duck.sql(t.to_sql("duckdb")).columns == ["n_nationkey", "x", "n"]
    assert "EXCEPT (`n_regionkey`)" in t.to_sql("bigquery")
    with pytest.raises(PlanError):
        t.to_sql("postgres")


def test_dialects_quote_alike():
    t = Table("o").filter(col("a`b") == "it's").select(col("a`b").alias("x"))
    assert "`a``b`" in t.to_sql("bigquery") and "'it''s'" in t.to_sql("snowflake") and '"a`b"' in t.to_sql("redshift")
    with pytest.raises(PlanError):
        t.to_sql("oracle")


def test_literals():
    d = datetime.datetime(2020, 1, 2, 3)
    assert [lit(v).to_sql() for v in (None, True, 1, 1.5, "a'b", d, d.date(), b"\x01")] == ["NULL", "TRUE", "1", "1.5", "'a''b'", "TIMESTAMP '2020-01-02 03:00:00'", "DATE '2020-01-02'", "X'01'"]
    assert star().to_sql() == "*"


def test_python_truth_is_refused():
    with pytest.raises(PlanError):
        bool((col("a") > 1) and (col("b") > 1))
    with pytest.raises(PlanError):
        1 < col("a") < 3  # noqa: B015
    assert {col("a"): 1}


def test_bad_joins():
    with pytest.raises(PlanError):
        Table("a").join(Table("b"), "k", "positional")
    with pytest.raises(PlanError):
        Table("a").join(Table("b"))


def test_spark_optimizes_the_plan(spark):
    df = Table(spark.read.parquet(f"{DATA}/lineitem.parquet")).select(col("l_orderkey"), (col("l_quantity") * 2).alias("q")).filter(col("l_orderkey") > 100).sort("q").limit(3).dataframe(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(l_orderkey), GreaterThan(l_orderkey,100)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_arrow_and_sources(spark):
    t = Table(f"{DATA}/region.parquet").select("r_name")
    assert t.to_arrow(spark).num_rows == 5 and repr(t) == "Table(Project)" and t.columns == ["r_name"]
    assert Table.from_sql("SELECT 1 AS a").with_columns(b=col("a") + 1).dataframe(spark).first().b == 2
