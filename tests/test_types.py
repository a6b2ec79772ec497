import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.types import FieldType, decode, encode, from_spark, join, join_all, meet, resolve_union, subsumes, to_spark
from tessera.types.semantic import JSON_BLOB

PLAIN = [pa.bool_(), pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.uint8(), pa.uint32(), pa.float32(), pa.float64(), pa.string(), pa.binary(), pa.date32(), pa.date64(), pa.timestamp("us"), pa.timestamp("ms", "UTC"), pa.decimal128(38, 18), pa.null()]
plain = st.sampled_from(PLAIN)
types = st.recursive(plain, lambda t: st.one_of(t.map(pa.list_), st.lists(t, min_size=1, max_size=3).map(lambda ts: pa.struct([pa.field(f"f{i}", x) for i, x in enumerate(ts)]))), max_leaves=5)
T = FieldType


@given(types)
def test_codec_round_trip(t):
    assert decode(encode(t)) == t


@given(types)
def test_join_is_idempotent(t):
    assert join(T(t), T(t)).arrow_type == t


@given(types)
def test_null_is_absorbed(t):
    assert join(T(t), T(pa.null())).arrow_type == t == join(T(pa.null()), T(t)).arrow_type


@given(st.lists(types, min_size=1, max_size=6), st.randoms())
def test_join_all_has_no_order(ts, rng):
    shuffled = list(ts)
    rng.shuffle(shuffled)
    assert join_all(ts) == join_all(shuffled + ts[:1])


@given(plain, plain)
def test_meet_is_below_both(a, b):
    m = meet(T(a), T(b))
    assert subsumes(T(a), m) and subsumes(T(b), m)


@pytest.mark.parametrize(
    ("a", "b", "out"),
    [
        (pa.int8(), pa.int64(), pa.int64()), (pa.uint8(), pa.int8(), pa.int64()), (pa.int64(), pa.float32(), pa.float64()), (pa.float16(), pa.float32(), pa.float32()),
        (pa.int64(), pa.decimal128(10, 2), pa.decimal128(38, 18)), (pa.date32(), pa.date64(), pa.date64()), (pa.date32(), pa.timestamp("us"), pa.timestamp("us")),
        (pa.timestamp("s", "UTC"), pa.timestamp("us"), pa.timestamp("us")), (pa.string(), pa.int64(), pa.string()), (pa.string(), pa.list_(pa.int8()), pa.string()), (pa.large_string(), pa.string(), pa.large_string()),
    ],
)
def test_widening(a, b, out):
    assert join(T(a), T(b)).arrow_type == out


def test_structs_join_by_field():
    a, b = pa.struct([("x", pa.int64()), ("y", pa.string())]), pa.struct([("x", pa.float64()), ("z", pa.bool_())])
    assert encode(join(T(a), T(b)).arrow_type) == "struct<x:float64,y:string,z:bool>"


def test_unions_and_blobs():
    u = join(T(pa.bool_()), T(pa.int64()))
    assert u.arrow_type == pa.string() and u.semantic == "union:bool|int64"
    for t in (pa.date32(), pa.binary(), pa.list_(pa.int64())):
        u = join(u, T(t))
    assert u.semantic == JSON_BLOB
    assert join(u, T(pa.float64())).semantic == JSON_BLOB  # a blob holds anything
    assert join_all([pa.bool_(), pa.int64(), pa.string()]) == (pa.string(), None)
    assert resolve_union(T(pa.string(), semantic="union:float64")).arrow_type == pa.float64()


def test_null_ratio_is_weighted():
    a, b = T(pa.int64(), null_ratio=0.5, sample_count=10), T(pa.null(), sample_count=10)
    assert join(a, b).null_ratio == 0.75 and join(a, b).sample_count == 20


@pytest.mark.parametrize(("a", "b", "yes"), [(pa.string(), pa.int64(), True), (pa.int64(), pa.int32(), True), (pa.int32(), pa.int64(), False), (pa.float64(), pa.int64(), True), (pa.decimal128(38, 18), pa.float64(), True), (pa.timestamp("us"), pa.date32(), True), (pa.bool_(), pa.int64(), False), (pa.list_(pa.int64()), pa.list_(pa.int8()), True), (pa.struct([("a", pa.int64())]), pa.struct([("a", pa.int32())]), False)])
def test_subsumes(a, b, yes):
    assert subsumes(T(a), T(b)) is yes


def test_struct_inclusion_is_an_option():
    a, b = pa.struct([("a", pa.int64()), ("b", pa.string())]), pa.struct([("a", pa.int32())])
    assert subsumes(T(a), T(b), structs=True) and not subsumes(T(b), T(a), structs=True)


@given(types)
def test_spark_types_hold_arrow_types(t):
    assert from_spark(to_spark(from_spark(to_spark(t)))) == from_spark(to_spark(t))


def test_codec_of_nested_parameters():
    t = pa.struct([("p", pa.decimal128(38, 18)), ("at", pa.timestamp("us", "UTC")), ("l", pa.list_(pa.struct([("d", pa.decimal128(5, 2))])))])
    assert decode(encode(t)) == t
    assert decode("double") == pa.float64() and decode("date32[day]") == pa.date32()
