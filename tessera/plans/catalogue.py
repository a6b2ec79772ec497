"""Queries over the test tables, one or more for each operator, with the SQL they are checked against."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.diff import diff
from tessera.functions import avg_, call, coalesce, col, concat, count_, count_distinct_, date_trunc, if_, length, lit, max_, min_, sum_, to_date
from tessera.infer import infer, infer_typed
from tessera.infer.infer import confidence
from tessera.infer.observe import OBSERVATION, observe_json
from tessera.lineage import Lineage
from tessera.normalize import normalize
from tessera.operators import Table
from tessera.pii.detect import matched
from tessera.pii.patterns import shapes
from tessera.plans.registry import dsl, frame, table
from tessera.quality import generate_tests, results_frame
from tessera.schema import Schema
from tessera.types import FieldType, encode

DAY = datetime.datetime

# --- scans and filters

dsl("scan_count", "SELECT COUNT(*) AS n FROM lineitem", "lineitem")(lambda t: t.select(count_("*").alias("n")))
dsl("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderdate >= TIMESTAMP '1996-01-01'", "orders")(lambda t: t.filter((col("o_totalprice") > 200000) & (col("o_orderdate") >= DAY(1996, 1, 1))).select(col("o_orderkey"), col("o_totalprice")))
dsl("filter_bool", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR NOT (l_discount <= 0.08)) AND l_returnflag <> 'N'", "lineitem")(lambda t: t.filter(((col("l_quantity") < 5) | ~(col("l_discount") <= 0.08)) & (col("l_returnflag") != "N")).select("l_orderkey", "l_linenumber"))
dsl("filter_chain", "SELECT l_orderkey, q2 FROM (SELECT l_orderkey, l_quantity * 2 AS q2 FROM lineitem WHERE l_tax > 0.03) WHERE q2 > 90", "lineitem")(lambda t: t.filter(col("l_tax") > 0.03).select(col("l_orderkey"), (col("l_quantity") * 2).alias("q2")).filter(col("q2") > 90))
dsl("filter_shadowed_alias", "SELECT l_orderkey, l_quantity FROM (SELECT l_orderkey, l_quantity * 2 AS l_quantity FROM lineitem) WHERE l_quantity > 80", "lineitem")(lambda t: t.select(col("l_orderkey"), (col("l_quantity") * 2).alias("l_quantity")).filter(col("l_quantity") > 80))
dsl("filter_between", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", "lineitem")(lambda t: t.filter(col("l_quantity").between(10, 20)).select(count_().alias("n"), sum_("l_quantity").alias("q")))
dsl("filter_in", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority", "orders")(lambda t: t.filter(col("o_orderstatus").in_(["F", "P"])).group_by("o_orderpriority").agg(count_().alias("n")))
dsl("filter_not_in", "SELECT COUNT(*) AS n FROM orders WHERE NOT (o_orderstatus IN ('F', 'P'))", "orders")(lambda t: t.filter(~col("o_orderstatus").in_(["F", "P"])).select(count_().alias("n")))
dsl("filter_in_empty", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> o_orderstatus", "orders")(lambda t: t.filter(col("o_orderstatus").in_([])).select("o_orderkey"))
_NULLED = "SELECT *, NULLIF(o_orderstatus, 'O') AS s FROM orders"


def _with_null(t: Table) -> Table:
    return t.with_column("s", if_(col("o_orderstatus") == "O", None, col("o_orderstatus")))


dsl("filter_null", f"SELECT COUNT(*) AS n, MIN(o_orderkey) AS k FROM ({_NULLED}) WHERE s IS NULL", "orders")(lambda t: _with_null(t).filter(col("s").is_null()).select(count_().alias("n"), min_("o_orderkey").alias("k")))
dsl("filter_not_null", f"SELECT s, COUNT(*) AS n FROM ({_NULLED}) WHERE s IS NOT NULL GROUP BY s", "orders")(lambda t: _with_null(t).filter(col("s").is_not_null()).group_by("s").agg(count_().alias("n")))
dsl("filter_equals_null", f"SELECT o_orderkey FROM ({_NULLED}) WHERE s = NULL", "orders")(lambda t: _with_null(t).filter(col("s") == lit(None)).select("o_orderkey"))
dsl("filter_raw_text", "SELECT p_partkey FROM part WHERE p_size + 1 > 49", "part")(lambda t: t.filter("p_size + 1 > 49").select("p_partkey"))

# --- text

dsl("like_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'P%'", "part")(lambda t: t.filter(col("p_type").like("P%")).select("p_partkey", "p_type"))
dsl("like_underscore", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_3'", "part")(lambda t: t.filter(col("p_brand").like("Brand#_3")).select("p_partkey"))
dsl("like_suffix", "SELECT p_partkey FROM part WHERE ends_with(p_brand, '1')", "part")(lambda t: t.filter(col("p_brand").endswith("1")).select("p_partkey"))
dsl("starts_with", "SELECT p_partkey FROM part WHERE starts_with(p_name, 'small')", "part")(lambda t: t.filter(col("p_name").startswith("small")).select("p_partkey"))
dsl("like_contains", "SELECT c_custkey FROM customer WHERE contains(c_name, '00')", "customer")(lambda t: t.filter(col("c_name").contains("00")).select("c_custkey"))
dsl("ilike", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%BUILD%'", "customer")(lambda t: t.filter(col("c_mktsegment").ilike("%build%")).select("c_custkey", "c_mktsegment"))
dsl("str_upper_lower_trim", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l, TRIM(CONCAT('  ', p_type, ' ')) AS t FROM part", "part")(lambda t: t.select(col("p_partkey"), col("p_name").upper().alias("u"), col("p_brand").lower().alias("l"), concat("  ", col("p_type"), " ").trim().alias("t")))
dsl("str_concat_nulls", "SELECT o_orderkey, CONCAT(o_orderpriority, '|', NULLIF(o_orderstatus, 'O')) AS c FROM orders", "orders")(lambda t: _with_null(t).select(col("o_orderkey"), concat(col("o_orderpriority"), "|", col("s")).alias("c")))
dsl("str_length", "SELECT doc_id, LENGTH(text) AS n FROM documents", "documents")(lambda t: t.select(col("doc_id"), length("text").alias("n")))

# --- columns

dsl("project_arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem", "lineitem")(lambda t: t.select(col("l_orderkey"), col("l_linenumber"), (col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax"))).alias("charge")))
dsl("project_reflected", "SELECT l_orderkey, l_linenumber, 1 - l_discount AS keep, 100 / l_quantity AS per FROM lineitem", "lineitem")(lambda t: t.select(col("l_orderkey"), col("l_linenumber"), (1 - col("l_discount")).alias("keep"), (100 / col("l_quantity")).alias("per")))
dsl("divide_by_zero", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 3 = 1 THEN '-Infinity'::DOUBLE ELSE o_orderkey / 2 END AS r FROM orders WHERE o_orderkey > 0", "orders")(lambda t: t.with_columns(a="CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE o_orderkey END", b="CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 0 END").filter(col("o_orderkey") > 0).select(col("o_orderkey"), (col("a") / col("b")).alias("r")))
dsl("with_column_new", "SELECT *, l_quantity * l_extendedprice AS gross FROM lineitem", "lineitem")(lambda t: t.with_column("gross", col("l_quantity") * col("l_extendedprice")))
dsl("with_column_replace", "SELECT * REPLACE (LOWER(n_name) AS n_name) FROM nation", "nation")(lambda t: t.with_column("n_name", col("n_name").lower()))
dsl("drop_cols", "SELECT c_custkey, c_name, c_mktsegment FROM customer", "customer")(lambda t: t.drop("c_nationkey", "c_acctbal"))
dsl("rename_cols", "SELECT r_regionkey AS id, r_name AS region FROM region", "region")(lambda t: t.rename(r_regionkey="id", r_name="region"))
dsl("cast_types", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS d, CAST(FLOOR(o_totalprice) AS BIGINT) AS i FROM orders", "orders")(lambda t: t.select(col("o_orderkey"), col("o_orderkey").cast("VARCHAR").alias("s"), col("o_orderdate").cast("DATE").alias("d"), "CAST(floor(o_totalprice) AS BIGINT) AS i"))
dsl("coalesce_fn", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'O'), 'none') AS s2 FROM orders", "orders")(lambda t: _with_null(t).select(col("o_orderkey"), coalesce(col("s"), "none").alias("s2")))
dsl("if_fn", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class FROM part", "part")(lambda t: t.select(col("p_partkey"), if_(col("p_size") > 25, "big", "small").alias("size_class")))
dsl("date_trunc_month", "SELECT CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS month, COUNT(*) AS n FROM orders GROUP BY 1", "orders")(lambda t: t.with_column("month", date_trunc("month", "o_orderdate")).group_by("month").agg(count_().alias("n")))
dsl("to_date_fn", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1", "events")(lambda t: t.select(to_date("ts").alias("day")).group_by("day").agg(count_().alias("n")))

# --- groups

dsl("agg_pricing_summary", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus", "lineitem")(lambda t: t.filter(col("l_shipdate") <= DAY(1998, 9, 2)).group_by("l_returnflag", "l_linestatus").agg(sum_("l_quantity").alias("q"), avg_("l_extendedprice").alias("p"), count_().alias("n")).select("l_returnflag", "l_linestatus", "round(q, 2) AS sum_qty", "round(p, 4) AS avg_price", "n").sort("l_returnflag", "l_linestatus"))
dsl("agg_global", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(DISTINCT o_custkey) AS customers FROM orders", "orders")(lambda t: t.select(count_().alias("n"), min_("o_totalprice").alias("lo"), max_("o_totalprice").alias("hi"), count_distinct_("o_custkey").alias("customers")))
dsl("agg_group", "SELECT o_orderpriority, COUNT(NULLIF(o_orderstatus, 'O')) AS n, MAX(o_orderdate) AS latest FROM orders GROUP BY o_orderpriority", "orders")(lambda t: _with_null(t).group_by("o_orderpriority").agg(col("s").count().alias("n"), col("o_orderdate").max().alias("latest")))
dsl("agg_multi_key", "SELECT c_nationkey, c_mktsegment, COUNT(*) AS n, MIN(c_acctbal) AS lo FROM customer GROUP BY c_nationkey, c_mktsegment", "customer")(lambda t: t.group_by("c_nationkey", "c_mktsegment").agg(count_().alias("n"), min_("c_acctbal").alias("lo")))
dsl("agg_distinct_count", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", "lineitem")(lambda t: t.group_by("l_returnflag").agg(count_distinct_("l_partkey").alias("parts")))
dsl("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", "orders")(lambda t: t.group_by("o_custkey").agg(count_().alias("n")).filter(col("n") > 12))
dsl("agg_aliased_key", "SELECT p_size AS size, COUNT(*) AS n FROM part GROUP BY p_size", "part")(lambda t: t.group_by(col("p_size").alias("size")).agg(count_().alias("n")))
dsl("group_no_agg", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "orders")(lambda t: t.group_by("o_orderstatus", "o_orderpriority").agg())

# --- joins

_ON_CUSTOMER = lambda: col("c_custkey", "_left") == col("o_custkey", "_right")
dsl("join_inner", "SELECT c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", "customer", "orders")(lambda a, b: a.join(b, _ON_CUSTOMER()).group_by("c_mktsegment").agg(count_().alias("n")))
_ORDER = lambda: col("o_orderkey", "_left") == col("l_orderkey", "_right")
dsl("join_left", "SELECT o_orderkey, COUNT(l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey", "orders", "lineitem")(lambda a, b: a.join(b, _ORDER(), "left").group_by("o_orderkey").agg(col("l_linenumber").count().alias("lines")))
dsl("join_right", "SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT * FROM orders WHERE o_totalprice > 400000) RIGHT JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) ON o_orderkey = l_orderkey", "orders", "lineitem")(lambda a, b: a.filter(col("o_totalprice") > 400000).join(b.filter(col("l_quantity") > 48), _ORDER(), "right").select("o_orderkey", "l_orderkey", "l_linenumber"))
dsl("join_full", "SELECT c_custkey, s_suppkey, c_nationkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3", "customer", "supplier")(lambda a, b: a.join(b, col("c_custkey", "_left") == col("s_suppkey", "_right") * 3, "full").select("c_custkey", "s_suppkey", "c_nationkey"))
dsl("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", "region", "region")(lambda a, b: a.select(col("r_name").alias("x")).join(b.select(col("r_name").alias("y")), how="cross"))
dsl("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer", "orders")(lambda a, b: a.join(b.filter(col("o_totalprice") > 300000), _ON_CUSTOMER(), "semi").select("c_custkey"))
dsl("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "orders", "lineitem")(lambda a, b: a.join(b, _ORDER(), "anti").select("o_orderkey"))
dsl("join_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", "nation", "region")(lambda a, b: a.join(b, col("n_regionkey", "_left") < col("r_regionkey", "_right")).select(col("n_nationkey").alias("x"), col("r_regionkey").alias("y")))
dsl("join_equi_theta", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice > 90000", "orders", "lineitem")(lambda a, b: a.join(b, _ORDER() & (col("l_shipdate", "_right") > col("o_orderdate", "_left")) & (col("l_extendedprice", "_right") > 90000)).select("o_orderkey", "l_linenumber"))
dsl("join_same_names", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_1, b.n_name AS n_name_1, b.n_regionkey AS n_regionkey_1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "nation", "nation")(lambda a, b: a.join(b, "n_regionkey"))
dsl("join_multi", "SELECT r_name, ROUND(SUM(o_totalprice), 2) AS total, COUNT(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name", "region", "nation", "customer", "orders")(lambda r, n, c, o: r.join(n, col("r_regionkey", "_left") == col("n_regionkey", "_right")).join(c, col("n_nationkey", "_left") == col("c_nationkey", "_right")).join(o, _ON_CUSTOMER()).group_by("r_name").agg(sum_("o_totalprice").alias("t"), count_().alias("n")).select("r_name", "round(t, 2) AS total", "n"))

# --- order, sets, windows

dsl("sort_nulls", f"SELECT o_orderkey, s FROM ({_NULLED}) ORDER BY s DESC NULLS LAST, o_orderkey", "orders")(lambda t: _with_null(t).sort(col("s").desc(), col("o_orderkey")).select("o_orderkey", "s"))
dsl("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")(lambda t: t.sort(col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"))
dsl("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 20", "orders")(lambda t: t.sort("o_orderdate", col("o_orderkey").asc()).limit(10, offset=20).select("o_orderkey"))
dsl("head", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5", "customer")(lambda t: t.order_by("c_custkey").select("c_custkey").head())
dsl("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer", "supplier")(lambda a, b: a.select(col("c_nationkey").alias("k")).union(b.select(col("s_nationkey").alias("k"))))
dsl("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")(lambda a, b: a.select(col("c_nationkey").alias("k")).union(b.select(col("s_nationkey").alias("k")), all=False))
dsl("union_by_name", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation", "region", "nation")(lambda a, b: a.union(b.select(col("n_name").alias("r_name"), col("n_nationkey").alias("r_regionkey")), by_name=True))
dsl("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "lineitem")(lambda t: t.select("l_returnflag", "l_linestatus", "l_linenumber").distinct())
dsl("window_rank", "SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders", "orders")(lambda t: _ranked(t))


def _ranked(t: Table) -> Table:
    ranked = t.window("o_custkey", [col("o_totalprice").desc(), col("o_orderkey")]).over(call("row_number").alias("r"))
    return ranked.select(col("o_orderkey"), col("o_custkey"), col("r").cast("BIGINT").alias("r"))


dsl("window_running", "SELECT o_orderkey, LAG(o_orderkey) OVER w AS before, COUNT(*) OVER w AS so_far, MAX(o_totalprice) OVER w AS most FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders")(
    lambda t: t.window("o_custkey", [col("o_orderdate"), col("o_orderkey")]).over(call("lag", col("o_orderkey")).alias("before"), count_().alias("so_far"), max_("o_totalprice").alias("most")).select("o_orderkey", "before", "so_far", "most")
)


# --- inference


def _mixed_documents(orders: DataFrame) -> DataFrame:
    """Orders as JSON text with nested objects, lists of objects, nulls and a field of two types."""
    status = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    key = F.col("o_orderkey").cast("string")
    parts = ['{"id":', key, ',"who":{"c":', F.col("o_custkey").cast("string"), ',"s":', F.coalesce(status, F.lit("null")), '},"tags":["', F.col("o_orderpriority"), '",null],"lines":[{"n":', key, '}],"v":', F.when(F.col("o_orderkey") % 2 == 1, "1.5").otherwise('"x"'), "}"]
    return orders.select(F.monotonically_increasing_id().alias("number"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("value"))


_MIXED = """
WITH seen AS (
  SELECT unnest([
    {path: 'id', kind: 'int64', v: o_orderkey::VARCHAR}, {path: 'who', kind: 'struct', v: NULL}, {path: 'who.c', kind: 'int64', v: o_custkey::VARCHAR},
    {path: 'who.s', kind: CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE 'string' END, v: NULLIF(o_orderstatus, 'O')}, {path: 'tags', kind: 'list', v: NULL}, {path: 'tags[]', kind: 'string', v: o_orderpriority},
    {path: 'tags[]', kind: 'null', v: NULL}, {path: 'lines', kind: 'list', v: NULL}, {path: 'lines[]', kind: 'struct', v: NULL}, {path: 'lines[].n', kind: 'int64', v: o_orderkey::VARCHAR},
    {path: 'v', kind: CASE WHEN o_orderkey % 2 = 1 THEN 'float64' ELSE 'string' END, v: CASE WHEN o_orderkey % 2 = 1 THEN '1.5' ELSE 'x' END}]) AS o FROM orders)
SELECT o.path AS path, o.kind AS kind, COUNT(*) AS n, COUNT(DISTINCT o.v) AS n_values FROM seen GROUP BY ALL
"""


@frame("infer_mixed_documents", _MIXED)
def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _mixed_documents(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return texts.mapInPandas(observe_json, OBSERVATION).groupBy("path", "kind").agg(F.sum("n").alias("n"), F.count_distinct("value").alias("n_values"))


@frame("infer_observations", "SELECT 'k' AS path, 'int64' AS kind, COUNT(*) AS n, COUNT(DISTINCT json_extract(props, '$.k')) AS n_values FROM events")
def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.monotonically_increasing_id().alias("number"), F.col("props").alias("value"))
    return texts.mapInPandas(observe_json, OBSERVATION).groupBy("path", "kind").agg(F.sum("n").alias("n"), F.count_distinct("value").alias("n_values"))


def _schema_rows(spark: SparkSession, schema: Schema) -> DataFrame:
    rows = [(n, encode(t.arrow_type), t.null_ratio, t.sample_count, t.semantic, t.pii_class) for n, t in schema.fields]
    return spark.createDataFrame(rows, "field string, type string, null_ratio double, n long, semantic string, pii_class string")


@frame("infer_json_schema", "SELECT 'k' AS field, 'int64' AS type, 0.0::DOUBLE AS null_ratio, COUNT(*) AS n, NULL::VARCHAR AS semantic, NULL::VARCHAR AS pii_class FROM events")
def _json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schema_rows(spark, infer(spark.read.parquet(f"{sf_dir}/events.parquet").select("props"), name="props", sample_size=None))


@frame("infer_typed_schema", "SELECT field, type, CASE WHEN few AND n > 200 THEN 'enum' END AS semantic, pii_class, null_ratio, n FROM (VALUES ('c_custkey','int64',FALSE,NULL),('c_name','string',FALSE,'name'),('c_nationkey','int32',FALSE,NULL),('c_acctbal','float64',FALSE,NULL),('c_mktsegment','string',TRUE,NULL)) v(field, type, few, pii_class), (SELECT 0.0::DOUBLE AS null_ratio, COUNT(*) AS n FROM customer)")
def _typed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schema_rows(spark, infer_typed(spark.read.parquet(f"{sf_dir}/customer.parquet"), "customer"))


@frame("null_ratio_profile", f"SELECT COUNT(*) AS n, COUNT(*) - COUNT(s) AS nulls, ROUND((COUNT(*) - COUNT(s)) / COUNT(*), 9) AS null_ratio, ROUND(LEAST(1, (1 - EXP(-COUNT(*) / 50)) * (1 - 0.5 * (COUNT(*) - COUNT(s)) / COUNT(*))), 9) AS confidence FROM ({_NULLED})")
def _null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = infer_typed(_with_null(table(spark, sf_dir, "orders")).dataframe(spark), "orders", pii=False)
    t = schema.field("s")
    return spark.createDataFrame([(t.sample_count, round(t.null_ratio * t.sample_count), round(t.null_ratio, 9), round(confidence(t.sample_count, t.null_ratio), 9))], "n long, nulls long, null_ratio double, confidence double")


@frame("cardinality_profile", "SELECT COUNT(DISTINCT o_orderstatus) AS status, COUNT(DISTINCT o_orderpriority) AS priority FROM orders")
def _cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = infer_typed(spark.read.parquet(f"{sf_dir}/orders.parquet"), "orders", pii=False)
    return spark.createDataFrame([(schema.field("o_orderstatus").cardinality_estimate, schema.field("o_orderpriority").cardinality_estimate)], "status long, priority long")


@frame("min_max_profile", "SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders")
def _min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = infer_typed(spark.read.parquet(f"{sf_dir}/orders.parquet"), "orders", pii=False).field("o_totalprice")
    return spark.createDataFrame([(t.min_value, t.max_value)], "lo double, hi double")


# --- personal data: words of documents that have each shape

def _sql_match(label: str, pattern: str, any_case: bool) -> str:
    """Whether a word has the shape, in SQL; the other engine's regexes have no lookahead, so what must not follow is asked for apart."""
    of = lambda p: f"regexp_full_match(w, '{p}', '{'i' if any_case else 'c'}')"
    if label == "ssn":
        return rf"({of(r'[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9}')} AND NOT {of(r'(000|666|9).*')} AND NOT {of(r'[0-9]{3}-?00.*')} AND NOT {of(r'.*0000')})"
    if label == "uk_nin":
        return f"({of('[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D]')} AND NOT {of('(BG|GB|NK|KN|TN|NT|ZZ).*')})"
    return of(pattern)


_SQL_COUNTS = " UNION ALL ".join(f"SELECT '{s.label}' AS class, COUNT(*) FILTER (WHERE {_sql_match(s.label, s.pattern, s.any_case)}) AS n FROM words" for s in shapes("all"))


@frame("pii_match_counts", f"WITH words AS (SELECT TRIM(unnest(string_split(regexp_replace(text, '\\s', ' ', 'g'), ' ')), '.,;:\"') AS w FROM documents) {_SQL_COUNTS}")
def _pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select(F.explode(F.split(F.regexp_replace("text", r"[\t\n\f\r ]", " "), " ")).alias("w")).select(F.btrim("w", F.lit(".,;:\"")).alias("w"))
    known = shapes("all")
    each = words.groupBy("w").agg(F.count("*").alias("n"))  # a word is looked at once, however often it occurs
    row = each.agg(*[F.sum(matched(F.col("w"), s) * F.col("n")).alias(s.label) for s in known])
    return row.select(F.explode(F.array(*[F.struct(F.lit(s.label).alias("class"), F.coalesce(F.col(s.label), F.lit(0)).alias("n")) for s in known])).alias("x")).select("x.class", "x.n")


@frame("pii_columns", "SELECT * FROM (VALUES ('c_name', 'name'), ('url', 'url'), ('s_name', 'name')) v(field, pii_class)")
def _pii_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("customer", "supplier", "pages"):
        schema = infer_typed(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)
        rows += [(n, t.pii_class) for n, t in schema.fields if t.pii_class]
    return spark.createDataFrame(rows, "field string, pii_class string")


# --- relational tables from nested rows


@frame("shred_array", "SELECT vec_id, i - 1 AS ordinal, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)")
def _shred_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    tables = normalize(Schema.from_spark("embeddings", df.schema)).apply(df, keys=["vec_id"])
    root, child = tables["embeddings"], tables["embeddings__embedding"]
    return child.join(root, child["__parent_id"] == root["__id"]).select("vec_id", child["__ordinal"].alias("ordinal"), child["value"].cast("double").alias("value"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer as a struct and their lines as a list."""
    o, c, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty")))).alias("items"))
    customer = c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place")).alias("customer"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).join(customer, o.o_custkey == customer.c_custkey).select("o_orderkey", "o_totalprice", "customer", "items")


@frame("shred_nested_root", "SELECT o_orderkey, o_totalprice, c_name AS customer__name FROM orders JOIN customer ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _shred_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nested_orders(spark, sf_dir)
    return normalize(Schema.from_spark("orders", df.schema)).apply(df, keys=["o_orderkey"])["orders"].select("o_orderkey", "o_totalprice", "customer__name")


@frame("shred_nested_items", "SELECT l_orderkey AS o_orderkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS ordinal, l_linenumber AS line, l_partkey AS part, l_quantity AS qty FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def _shred_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nested_orders(spark, sf_dir)
    tables = normalize(Schema.from_spark("orders", df.schema)).apply(df, keys=["o_orderkey"])
    root, items = tables["orders"], tables["orders__items"]
    return items.join(root, items["__parent_id"] == root["__id"]).select("o_orderkey", items["__ordinal"].alias("ordinal"), "line", "part", "qty")


@frame("shred_recursive", "SELECT o_orderkey, c_nationkey AS customer__place__nation, c_mktsegment AS customer__place__segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _shred_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = nested_orders(spark, sf_dir)
    return normalize(Schema.from_spark("orders", df.schema), recursive=True).apply(df, keys=["o_orderkey"])["orders"].select("o_orderkey", "customer__place__nation", "customer__place__segment")


@frame("inline_json", "SELECT c_custkey, '{\"n\":' || c_nationkey || ',\"s\":\"' || c_mktsegment || '\"}' AS at FROM customer")
def _inline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).alias("at"))
    return normalize(Schema.from_spark("c", df.schema), "mongo").apply(df, keys=["c_custkey"])["c"].drop("__id")


# --- quality


@frame("quality_suite", f"WITH t AS ({_NULLED}) SELECT 'not_null__o_orderkey' AS test, TRUE AS passed, 0.0::DOUBLE AS actual UNION ALL SELECT 'null_ratio__s', FALSE, ROUND((COUNT(*) - COUNT(s)) / COUNT(*), 9) FROM t UNION ALL SELECT 'cardinality__o_orderpriority', TRUE, COUNT(DISTINCT o_orderpriority)::DOUBLE FROM t UNION ALL SELECT 'range__o_totalprice', FALSE, COUNT(*) FILTER (WHERE o_totalprice > 100000)::DOUBLE FROM t UNION ALL SELECT 'not_null__o_totalprice', TRUE, 0.0 UNION ALL SELECT 'not_null__o_orderpriority', TRUE, 0.0 UNION ALL SELECT 'semantic__o_orderpriority__enum', TRUE, NULL")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_null(table(spark, sf_dir, "orders")).dataframe(spark)
    known = Schema("orders", (
        ("o_orderkey", FieldType(pa.int64(), sample_count=10)),
        ("s", FieldType(pa.string(), null_ratio=0.01, sample_count=100)),
        ("o_orderpriority", FieldType(pa.string(), sample_count=300, semantic="enum", cardinality_estimate=5)),
        ("o_totalprice", FieldType(pa.float64(), sample_count=10, min_value=0.0, max_value=100000.0)),
    ))
    return results_frame(generate_tests(known), df).withColumn("actual", F.round("actual", 9))


# --- schemas alone


def customer_schemas() -> tuple[Schema, Schema]:
    old = Schema("customer", (("id", FieldType(pa.int32())), ("name", FieldType(pa.string())), ("age", FieldType(pa.int64(), null_ratio=0.1)), ("gone", FieldType(pa.bool_()))))
    new = Schema("customer", (("id", FieldType(pa.int64())), ("name", FieldType(pa.int64())), ("age", FieldType(pa.int64())), ("email", FieldType(pa.string(), null_ratio=0.2, pii_class="email"))))
    return old, new


@frame("schema_diff_rows", "SELECT * FROM (VALUES ('id', 'type_changed', 'safe'), ('name', 'type_changed', 'risky'), ('age', 'nullable_changed', 'risky'), ('gone', 'removed', 'breaking'), ('email', 'added', 'safe')) v(path, kind, severity)")
def _diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(*customer_schemas()).to_dataframe(spark).drop("description")


@frame("normalize_tables", "SELECT * FROM (VALUES ('orders', '__id'), ('orders', 'o_orderkey'), ('orders', 'o_totalprice'), ('orders', 'customer__name'), ('orders', 'customer__place'), ('orders__items', '__id'), ('orders__items', '__parent_id'), ('orders__items', '__ordinal'), ('orders__items', 'line'), ('orders__items', 'part'), ('orders__items', 'qty')) v(table_name, column_name)")
def _normalize_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = normalize(Schema.from_spark("orders", nested_orders(spark, sf_dir).schema))
    return spark.createDataFrame([(t.name, n) for t in plan.tables for n in t.field_names], "table_name string, column_name string")


@frame("lineage_edges", "SELECT * FROM (VALUES ('orders.customer.name', 'orders.customer__name', 'flatten'), ('orders.customer.place', 'orders.customer__place', 'flatten'), ('orders.items', 'orders__items', 'extract_array')) v(source, target, transform)")
def _lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph: Lineage = normalize(Schema.from_spark("orders", nested_orders(spark, sf_dir).schema)).lineage
    return graph.to_dataframe(spark).drop("confidence")
