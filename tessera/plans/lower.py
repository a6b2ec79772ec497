"""Table expressions as Spark DataFrames."""

from __future__ import annotations

from functools import singledispatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.expression import Expression, Order, strip
from tessera.plans import logical as L

_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def _sorting(e: Expression):
    return (e if isinstance(e, Order) else Order(e, False)).column()


@singledispatch
def lower(node: L.Node, spark: SparkSession | None) -> DataFrame:
    raise TypeError(f"no lowering for {type(node).__name__}")


@lower.register
def _(node: L.Scan, spark) -> DataFrame:
    if isinstance(node.source, DataFrame):
        return node.source
    spark = spark or SparkSession.active()
    if "/" in node.source or node.source.endswith(".parquet"):
        if node.source.endswith((".json", ".ndjson", ".jsonl")):
            return spark.read.json(node.source, multiLine=node.source.endswith(".json"))
        return spark.read.parquet(node.source)
    return spark.table(node.source)


@lower.register
def _(node: L.RawQuery, spark) -> DataFrame:
    return (spark or SparkSession.active()).sql(node.sql)


@lower.register
def _(node: L.Filter, spark) -> DataFrame:
    return lower(node.child, spark).filter(node.test.column())


@lower.register
def _(node: L.Project, spark) -> DataFrame:
    return lower(node.child, spark).select(*[e.column() for e in node.exprs])


@lower.register
def _(node: L.Assign, spark) -> DataFrame:
    return lower(node.child, spark).withColumn(node.name, strip(node.expr).column())


@lower.register
def _(node: L.Drop, spark) -> DataFrame:
    return lower(node.child, spark).drop(*node.names)


@lower.register
def _(node: L.Rename, spark) -> DataFrame:
    return lower(node.child, spark).withColumnsRenamed(dict(node.names))


@lower.register
def _(node: L.Join, spark) -> DataFrame:
    left, right = lower(node.left, spark), lower(node.right, spark)
    one, two = left.alias("_left"), right.alias("_right")
    if node.how == "cross":
        out = one.crossJoin(two)
    else:
        out = one.join(two, node.on.column(), _HOW[node.how])
    if node.how in ("semi", "anti"):
        return out
    names = L.suffixed(left.columns, right.columns)
    return out.select(*[F.col(f"_left.`{c}`") for c in left.columns], *[F.col(f"_right.`{c}`").alias(n) for c, n in zip(right.columns, names, strict=True)])


@lower.register
def _(node: L.Aggregate, spark) -> DataFrame:
    child, keys = lower(node.child, spark), [e.column() for e in node.keys]
    if not node.aggs:
        return child.select(*keys).distinct()
    aggs = [e.column() for e in node.aggs]
    return child.groupBy(*keys).agg(*aggs) if keys else child.agg(*aggs)


@lower.register
def _(node: L.Sort, spark) -> DataFrame:
    return lower(node.child, spark).orderBy(*[_sorting(e) for e in node.keys])


@lower.register
def _(node: L.Limit, spark) -> DataFrame:
    child = lower(node.child, spark)
    return (child.offset(node.offset) if node.offset else child).limit(node.n)


@lower.register
def _(node: L.Union, spark) -> DataFrame:
    left, right = lower(node.left, spark), lower(node.right, spark)
    both = left.unionByName(right) if node.by_name else left.union(right)
    return both if node.all else both.distinct()


@lower.register
def _(node: L.Distinct, spark) -> DataFrame:
    return lower(node.child, spark).distinct()


@lower.register
def _(node: L.Windowed, spark) -> DataFrame:
    window = Window.partitionBy(*[e.column() for e in node.partition_by]).orderBy(*[_sorting(e) for e in node.order_by])
    return lower(node.child, spark).select("*", *[strip(e).column().over(window).alias(e.name or strip(e).to_sql()) for e in node.exprs])
