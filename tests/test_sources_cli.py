import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pyarrow as pa
import pytest

from tessera import infer
from tessera.cli import main
from tessera.errors import SourceError
from tessera.lineage import Lineage
from tessera.sources import JSONSource, KafkaSource, MongoSource, ParquetSource, PostgresSource, RESTSource, Source
from tessera.sources.rest import records_of, with_params
from tessera.streaming import IncrementalInference
from tests.conftest import DATA

DOCS = [{"a": 1, "b": {"c": "x"}}, {"a": 2.5, "b": {"c": None}}, {"a": 3, "l": [1, 2]}]


def test_json_files(spark, tmp_path):
    lines, whole, one, scalar = (tmp_path / n for n in ("d.ndjson", "d.json", "one.json", "s.json"))
    lines.write_text("\n".join(json.dumps(d) for d in DOCS) + "\n\n")
    whole.write_text(json.dumps(DOCS, indent=1))
    one.write_text(json.dumps(DOCS[0]))
    scalar.write_text("5")
    assert list(JSONSource(str(lines)).read()) == DOCS
    assert sorted(map(json.dumps, JSONSource(str(whole)).read())) == sorted(map(json.dumps, DOCS))
    assert list(JSONSource(str(one)).read()) == DOCS[:1] and list(JSONSource(str(scalar)).read()) == []
    schema = infer(JSONSource(str(lines)), detect_pii=False)
    assert JSONSource(str(lines)).parsed(spark, schema.to_spark()).count() == 3
    lines.write_text("{bad\n")
    with pytest.raises(Exception):
        JSONSource(str(lines)).parsed(spark, schema.to_spark()).collect()


def test_parquet(spark):
    s = ParquetSource(f"{DATA}/region.parquet")
    assert isinstance(s, Source) and len(list(s.read())) == 5 and s.schema_hint()["arrow_schema"].names == ["r_regionkey", "r_name"]


def test_rest(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            page = int(q.get("page", q.get("after", ["1"]))[0])
            body = {"items": [{"id": page * 10 + i} for i in range(2)] if page < 4 else [], "next": page + 1 if page < 3 else None}
            out = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/x"
    ids = lambda s: sorted(r["id"] for r in s.read())
    paged = {"type": "page", "page_param": "page"}
    assert ids(RESTSource(url)) == [10, 11]
    assert ids(RESTSource(url, pagination=paged)) == [10, 11, 20, 21, 30, 31] and ids(RESTSource(url, pagination=paged, max_pages=2)) == [10, 11, 20, 21]
    assert ids(RESTSource(url, pagination={"type": "cursor", "cursor_key": "next", "cursor_param": "after"})) == [10, 11, 20, 21, 30, 31]
    assert RESTSource(url, pagination=paged, pages=3).dataframe(spark).count() == 6
    server.shutdown()
    assert with_params("u?a=1", {"b": 2}) == "u?a=1&b=2" and records_of({"z": [1]}, "z") == [1] and records_of({"q": 1}) == [] and records_of([1]) == [1]


def test_external_stores(spark):
    p = PostgresSource("postgresql://u:p@h:5/db", query="SELECT 1", table="t")
    assert p.options() == {"url": "jdbc:postgresql://h:5/db", "driver": "org.postgresql.Driver", "fetchsize": "1000", "user": "u", "password": "p", "query": "SELECT 1"}
    with pytest.raises(ValueError):
        PostgresSource("x")
    assert MongoSource("m", "d", "c", {"a": 1}, {"b": 1}, 5).pipeline() == [{"$match": {"a": 1}}, {"$project": {"b": 1}}, {"$limit": 5}]
    with pytest.raises(SourceError):
        MongoSource("mongodb://x", "d", "c").dataframe(spark)
    with pytest.raises(SourceError):
        KafkaSource("h:1", "t").dataframe(spark)
    payloads = spark.createDataFrame([(b'{"a": 1}',), (b"[1]",), (b"bad",), (None,)], "value binary")
    assert [r.value for r in KafkaSource.objects(payloads).collect()] == ['{"a": 1}']


def test_jdbc(spark):
    """The reads of PostgresSource over the one database that Spark brings along."""
    derby = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    url = "jdbc:derby:memory:tessera;create=true"
    rows = [(i, f"n{i}", i * 0.5) for i in range(100)]
    spark.createDataFrame(rows, "id int, name string, x double").write.jdbc(url, "things", properties=derby)
    some = PostgresSource(url, query='SELECT "id", "name", "x" FROM things WHERE "id" > 97', partitioning=derby)
    assert sorted(some.read(), key=lambda r: r["id"]) == [dict(zip(("id", "name", "x"), r)) for r in rows[98:]]
    whole = PostgresSource(url, table="things", batch_size=7, partitioning=derby | {"partitionColumn": "id", "lowerBound": 0, "upperBound": 100, "numPartitions": 4}).dataframe(spark)
    assert whole.rdd.getNumPartitions() == 4 and sorted(map(tuple, whole.collect())) == rows
    assert [t.arrow_type for _, t in infer(whole, detect_pii=False).fields] == [pa.int32(), pa.string(), pa.float64()]


def test_lineage():
    g = Lineage()
    g.record("a.b", "t.c", "flatten")
    g.record("a.b", 't."d')
    assert len(g.downstream("a.b")) == 2 and g.upstream("t.c")[0].transform == "flatten" and g.upstream("x") == []
    assert '"a.b" -> "t.c" [label="flatten"];' in g.to_dot() and len(g) == 2
    start, done = g.to_openlineage("load")
    assert (start["eventType"], done["eventType"]) == ("START", "COMPLETE") and start["run"] == done["run"] and start["run"] != g.to_openlineage("other")[0]["run"]
    (out,) = done["outputs"]
    fields = out["facets"]["columnLineage"]["fields"]
    assert out["name"] == "t" and done["inputs"] == [{"namespace": "tessera", "name": "a"}] and fields["c"]["inputFields"][0]["field"] == "b" and fields["c"]["inputFields"][0]["transformations"][0]["description"] == "flatten"
    assert Lineage().to_openlineage() == []
    g.record("t.c", "u.x")
    g.record("u.x", "a.b")  # a cycle
    assert [str(e.target) for e in g.downstream("a.b", transitive=True)] == ["t.c", 't."d', "u.x", "a.b"] and len(g.upstream("u.x", transitive=True)) == 3
    assert [str(e.source) for e in g.upstream("u.x")] == ["t.c"]


def test_whole_tables_are_sorted(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["sort_nulls"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/orders.parquet").count() and rows == sorted(rows, key=lambda r: (r.s is None, [-ord(c) for c in r.s or ""], r.o_orderkey))


def test_cli(spark, tmp_path, capsys):
    data, old, new = tmp_path / "d.ndjson", tmp_path / "old.json", tmp_path / "new.json"
    data.write_text("\n".join(map(json.dumps, DOCS)))
    assert main(["infer", str(data), "--name", "o", "-o", str(old)]) == 0
    data.write_text(json.dumps({"a": "x"}))
    assert main(["infer", str(data), "--name", "o", "-o", str(new)]) == 0
    assert main(["diff", str(old), str(new)]) == 1 and main(["diff", str(old), str(old)]) == 0
    assert main(["ddl", str(old), "--dialect", "snowflake", "--if-not-exists"]) == 0
    assert main(["normalize", str(old), "--dialect", "bigquery"]) == 0
    assert main(["lineage", str(old), "--format", "openlineage"]) == 0 and main(["test", str(old), "--sensitivity", "1.5"]) == 0
    out = capsys.readouterr().out
    assert "IF NOT EXISTS" in out and "`o__l`" in out and "extract_array" in out and "[BREAKING]" in out


def test_streaming_inference(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "seen"
    source.mkdir()
    (source / "1.txt").write_text("\n".join(map(json.dumps, DOCS[:2])))
    inc = IncrementalInference(str(store), "o")
    for i, doc in enumerate(({"a": 1}, DOCS[2])):
        inc.start(spark.readStream.schema("value string").text(str(source)), str(tmp_path / "ck")).awaitTermination()
        (source / f"{i + 2}.txt").write_text(json.dumps(doc))
    inc.start(spark.readStream.schema("value string").text(str(source)), str(tmp_path / "ck")).awaitTermination()
    assert inc.schema(spark).fields == infer([*DOCS[:2], {"a": 1}, DOCS[2]], name="o").fields
