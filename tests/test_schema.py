import json

import pyarrow as pa
import pytest

from tessera.errors import PathNotFoundError
from tessera.schema import Path, PathSegment, Schema
from tessera.types import FieldType

NESTED = Schema("orders", (
    ("id", FieldType(pa.int64())),
    ("customer", FieldType(pa.struct([("name", pa.string()), ("address", pa.struct([("city", pa.string())]))]))),
    ("items", FieldType(pa.list_(pa.struct([("sku", pa.string()), ("price", pa.decimal128(38, 18))])), cardinality_estimate=3)),
    ("m", FieldType(pa.list_(pa.list_(pa.int64())), null_ratio=0.25, sample_count=8, tags=("a", "b"), semantic="enum", min_value=1)),
))


@pytest.mark.parametrize("text", ["", "a", "a.b", "items[].sku", "m[][]", "a[].b[].c"])
def test_path_round_trip(text):
    assert str(Path.parse(text)) == text


def test_path_relations():
    p = Path.parse("items[].sku")
    assert p.parent == Path.parse("items[]") and p.depth == 3 and p.is_descendant_of(Path.parse("items")) and not p.is_descendant_of(p)
    assert Path() / "a" / "b" == Path.parse("a.b") and Path.ROOT.is_root() and Path.root() == Path()
    with pytest.raises(ValueError):
        PathSegment("index")


def test_access():
    assert NESTED.path("customer.address.city").arrow_type == pa.string()
    assert NESTED.path("items[].price").arrow_type == pa.decimal128(38, 18)
    assert NESTED.path("m[][]").arrow_type == pa.int64()
    assert "id" in NESTED and "x" not in NESTED and len(NESTED) == 4 and NESTED.get_field("x") is None
    for bad in ("x", "id.y", "customer[]", "customer.zip"):
        with pytest.raises(PathNotFoundError):
            NESTED.path(bad)


def test_walk_is_preorder():
    assert [str(p) for p, _ in NESTED.walk()] == ["id", "customer", "customer.name", "customer.address", "customer.address.city", "items", "items[]", "items[].sku", "items[].price", "m", "m[]", "m[][]"]
    assert [str(p) for p, _ in NESTED.walk_arrays()] == ["items", "m", "m[]"]


def test_json_round_trip():
    assert Schema.from_json(json.loads(json.dumps(NESTED.to_json()))) == NESTED


def test_arrow_and_spark_round_trip():
    s = Schema("s", (("a", FieldType(pa.int64(), semantic="enum", pii_class="name")), ("b", FieldType(pa.list_(pa.string())))))
    assert Schema.from_arrow("s", s.to_arrow()) == s
    assert Schema.from_spark("s", s.to_spark()) == s
    assert s.to_arrow().field("a").nullable is False


def test_changes_copy():
    s = NESTED.add_field("id", FieldType(pa.string()))
    assert s.field_names[-1] == "id" and NESTED.field_names[0] == "id"
    assert "id" not in NESTED.drop_field("id") and NESTED.rename("x").name == "x" and "id: int64" in repr(NESTED)
