import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

OWN = [n for n in entry.queries() if not (n.startswith("op") and n[2:3].isdigit()) and n != "pipeline"]


def cells(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or str(v) in ("NaT", "<NA>", "nan"):
            return "null"
        if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind == "b":
            return str(bool(v))
        try:
            return f"{float(v):.9g}" if not isinstance(v, str) else str(v)
        except (TypeError, ValueError):
            return str(v).replace(" 00:00:00", "")

    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(name, spark, duck):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
