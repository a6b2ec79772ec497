import datetime
import json

import pytest
from pyspark.sql import functions as F

from tessera import infer
from tessera.errors import EmptySourceError
from tessera.infer import infer_typed
from tessera.infer.infer import sample
from tessera.types import encode

ORDERS = [
    {"order_id": "A", "customer": {"name": "x", "phone": None, "address": {"city": "P"}}, "items": [{"sku": "1", "price": 1.5, "qty": 1}], "tags": []},
    {"order_id": "B", "customer": {"name": "y", "phone": "1", "address": {"city": "Q"}}, "items": [{"sku": "2", "price": 2.0, "qty": 2}, {"sku": "3", "price": 1.0, "qty": 1}], "tags": ["a"], "m": [[1], [2, 3]]},
]


def shape(schema):
    return {n: encode(t.arrow_type) for n, t in schema.fields}


@pytest.fixture(params=["local", "spark"])
def inferred(request, spark):
    """The same inference on documents in hand and on a DataFrame of their text."""

    def run(docs, **how):
        if request.param == "local":
            return infer(docs, **how)
        return infer(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").repartition(3, "value"), **how)

    return run


def test_nested(inferred):
    s = inferred(ORDERS)
    assert shape(s) == {"order_id": "string", "customer": "struct<name:string,phone:string,address:struct<city:string>>", "items": "list<struct<sku:string,price:float64,qty:int64>>", "tags": "list<string>", "m": "list<list<int64>>"}


def test_polymorphic_fields(inferred):
    s = inferred([{"v": 1, "w": True}, {"v": 2.5, "w": 3}, {"v": None, "w": False}, {"v": 3}])
    assert encode(s.field("v").arrow_type) == "float64" and s.field("v").null_ratio == 0.25
    assert s.field("w").semantic == "union:bool|int64" and s.field("w").sample_count == 3
    assert encode(inferred([{"v": 1}, {"v": "a"}, {"v": True}]).field("v").arrow_type) == "string"


def test_container_nulls_are_over_all_observations(inferred):
    s = inferred([{"a": {"x": 1}}, {"a": None}, {"a": {"x": 2}}, {"a": {}}])
    assert s.field("a").null_ratio == 0.25 and s.field("a").is_struct


def test_absent_keys_are_not_nulls(inferred):
    assert inferred([{"id": 1, "extra": 1}, {"id": 2}]).field("extra").null_ratio == 0.0


def test_enum_and_bounds(inferred):
    s = inferred([{"status": "abcd"[i % 4], "id": i, "u": f"u{i}", "f": i / 2} for i in range(300)])
    assert s.field("status").semantic == "enum" and s.field("u").semantic is None
    assert (s.field("id").min_value, s.field("id").max_value, s.field("f").max_value) == (0, 299, 149.5)
    assert s.field("status").cardinality_estimate == 4 and 0.99 < s.field("id").confidence <= 1


def test_pii_by_name_and_value(inferred):
    s = inferred([{"contact": f"u{i}@example.com", "ip_address": "x", "n": 1} for i in range(5)])
    assert (s.field("contact").pii_class, s.field("ip_address").pii_class, s.field("n").pii_class) == ("email", "ip", None)
    assert inferred([{"contact": "a@b.co"}], detect_pii=False).field("contact").pii_class is None


def test_empty(inferred):
    assert len(infer([], fail_on_empty=False)) == 0
    with pytest.raises(EmptySourceError):
        infer([])


def test_sampling_repeats_with_a_seed(inferred):
    docs = [{f"k{i}": i} for i in range(300)]
    a, b = inferred(docs, sample_size=20, seed=7), inferred(docs, sample_size=20, seed=7)
    assert a == b and len(a) == 20


def test_field_order():
    docs = [{"s": {"x": 1}, "a": 1}]
    assert infer(docs).field_names == ["s", "a"] and infer(docs, order="depth").field_names == ["a", "s"]


def test_python_types():
    s = infer([{"b": b"x", "d": datetime.date(2020, 1, 1), "t": datetime.datetime(2020, 1, 1)}])
    assert shape(s) == {"b": "binary", "d": "date32", "t": "timestamp[us]"}


def test_too_deep_documents_are_left_out():
    deep = current = {}
    for _ in range(60):
        current["x"] = {}
        current = current["x"]
    assert infer([deep, {"a": 1}]).field_names == ["a"]


def test_malformed_json_raises(spark):
    with pytest.raises(Exception, match="JSON|Expecting"):
        infer(spark.createDataFrame([("{bad",)], "value string"))


def test_typed_frame(spark):
    df = spark.createDataFrame([(1, "a@b.co", [1, 2]), (2, None, [])], "id int, mail2 string, l array<int>")
    s = infer_typed(df, "t")
    assert shape(s) == {"id": "int32", "mail2": "string", "l": "list<int32>"}
    assert s.field("mail2").null_ratio == 0.5 and s.field("mail2").pii_class == "email" and s.field("l").cardinality_estimate == 2
    assert infer(df) .field_names == s.field_names


def test_documents_left_out_are_told(inferred):
    deep = 1
    for _ in range(60):
        deep = {"d": deep}
    with pytest.warns(UserWarning, match="3 documents"):
        s = inferred([{"a": 1, "": 2}, deep, {"a": 2, "x": deep}, [1]])
    assert shape(s) == {"a": "int64", "": "int64"} and s.field("a").sample_count == 1
    with pytest.warns(UserWarning, match="1 documents"), pytest.raises(EmptySourceError):
        inferred([deep])


def test_samples_are_uniform(spark):
    """Whatever repeats: half of the rows have one text."""
    texts = spark.range(40_000).repartition(9).select(F.when(F.col("id") % 2 == 0, '{"hot": 1}').otherwise(F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit("}"))).alias("value")).select(F.monotonically_increasing_id().alias("number"), "value").cache()
    for size in (1, 100, 2000):
        got = sample(texts, size, 3).collect()
        assert len(got) == size and sample(texts, size, 3).collect() == got != sample(texts, size, 4).collect()
    hot = sum("hot" in r.value for r in got)
    assert 850 < hot < 1150 and sample(texts, 50_000, 3).count() == 40_000 and sample(texts.where("false"), 5, 3).count() == 0
    assert got == texts.orderBy(F.xxhash64(F.lit(3), "number")).limit(2000).collect()
