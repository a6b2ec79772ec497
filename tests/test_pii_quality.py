import pyarrow as pa
import pytest

from tessera import infer
from tessera.pii import count_columns, detect_pii, detect_pii_from_field_name, shapes
from tessera.pii.detect import count_values
from tessera.quality import generate_tests, run_test, run_tests
from tessera.schema import Schema
from tessera.types import FieldType


@pytest.mark.parametrize(
    ("name", "label"),
    [("email", "email"), ("customer_email", "email"), ("ip_address", "ip"), ("clientip", "ip"), ("home_address", "address"), ("first_name", "name"), ("FullName", "name"), ("dob", "dob"), ("pan_number", "pan"), ("gst_no", "gstin"), ("cc_no", "credit_card"), ("bank_account", "iban"), ("api_token", "secret"), ("lat", "geo"), ("age_group", "age"), ("passport", "national_id"), ("a.b.phone", "phone"), ("urls", None), ("panel", None), ("amount", None)],
)
def test_names(name, label):
    assert detect_pii_from_field_name(name) == label


VALUES = {
    "email": (["a@b.co", "x.y+z@q.example.org"], ["a@b", "@b.co", "a b@c.de", "a@b.co\n"]),
    "pan": (["ABCDE1234F", "abcde1234f"], ["ABCD1234F", "ABCDE12345"]),
    "aadhaar": (["234567890123"], ["134567890123", "23456789012"]),
    "ssn": (["123-45-6789", "123456789"], ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"]),
    "credit_card": (["4111111111111111", "340000000000009"], ["1111111111111111"]),
    "ip": (["1.2.3.4"], ["1.2.3", "a.b.c.d"]),
    "uuid": (["123e4567-e89b-12d3-a456-426614174000"], ["123e4567-e89b-62d3-a456-426614174000"]),
    "gstin": (["22AAAAA0000A1Z5"], ["52AAAAA0000A1Z5"]),
    "iban": (["DE89370400440532013000"], ["D189370400440532013000"]),
    "uk_nin": (["AB123456C"], ["BG123456C"]),
    "us_zip": (["12345", "12345-6789"], ["1234"]),
}


@pytest.mark.parametrize("label", VALUES)
def test_shapes_in_python_and_java(label, spark):
    good, bad = VALUES[label]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert count_columns(df, "all")["v"][1][label] == len(good) == count_values(good + bad, shapes("all"))[1][label]


def test_detection():
    s = Schema("t", (("v", FieldType(pa.string())), ("email", FieldType(pa.string())), ("w", FieldType(pa.string(), pii_class="kept")), ("x", FieldType(pa.string()))))
    out = detect_pii(s, {"v": ["234567890123"] * 9 + ["x"], "x": ["a@b.co", "y"], "email": []})
    assert [t.pii_class for _, t in out.fields] == ["aadhaar", "email", "kept", None]
    assert detect_pii(s, {"x": ["a@b.co", "y"]}, confidence_threshold=0.5).field("x").pii_class == "email"
    assert detect_pii(s, layers=["regex"]).field("email").pii_class is None
    assert {x.label for x in shapes("none")} == {x.label for x in shapes("common")}


def test_quality(spark):
    docs = [{"id": i, "kind": "ab"[i % 2], "opt": None if i % 10 == 0 else i, "items": [{"sku": "x", "n": i}]} for i in range(300)]
    schema = infer(docs, name="t", detect_pii=False)
    tests = generate_tests(schema, sensitivity=1.5)
    kinds = {t.name: t for t in tests}
    assert kinds["cardinality__kind"].metadata == {"expected_max_cardinality": 3} and kinds["null_ratio__opt"].severity == "warning"
    good = spark.createDataFrame([(i, "a", i + 1, [("x", i)]) for i in range(3)], "id long, kind string, opt long, items array<struct<sku:string,n:long>>")
    assert all(r.passed for r in run_tests(tests, good))
    bad = spark.createDataFrame([(None, "a", None, [(None, 1)]), (999, "b", None, []), (1, "c", 1, None), (2, "d", 1, None)], good.schema)
    failed = {r.test.name for r in run_tests(tests, bad) if not r.passed}
    assert failed == {"not_null__id", "range__id", "cardinality__kind", "null_ratio__opt", "not_null__items"}
    assert not run_test(kinds["not_null__id"], good.drop("id")).passed


def test_nested_and_semantic_quality(spark):
    s = Schema("t", (("l", FieldType(pa.list_(pa.struct([("n", pa.int64())])), sample_count=1)), ("mail", FieldType(pa.string(), semantic="email", pii_class="email"))))
    tests = {t.kind: t for t in generate_tests(s)}
    df = spark.createDataFrame([([(1,)], "a@b.co"), ([(2,)], "nope")], "l array<struct<n:long>>, mail string")
    assert run_test(tests["semantic"], df).actual_value == 1 and run_test(tests["pii"], df).passed
    assert tests["semantic"].sql_template is None and tests["not_null"].sql_template == 'SELECT COUNT(*) FROM {table} WHERE "l" IS NULL'
