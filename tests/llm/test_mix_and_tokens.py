import collections
import glob
import itertools
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, token_files
from tessera.llm.store import materialize
from tessera.llm.tokens import Encoder, encoder
from tests.llm.conftest import WORD, odd_rows, thue_morse


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    t = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert all(x <= 2 * s + 1e-6 for x, s in zip(t, sizes)) and abs(t.sum() - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 1.5, 2).tolist() == [20, pytest.approx(295 * 2 / 3), pytest.approx(295 / 3)]


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("string")).alias("source"), (F.pow(F.rand(3), -0.8) * 20).cast("long").alias("n"))
    docs = materialize(docs, "test-mix")
    runs = [mixing.mix(d, size=d.n).select("row.doc_id", "row.source", "size", "target", "copies").toPandas().sort_values("doc_id").reset_index(drop=True) for d in (docs, docs.repartition(5))]
    assert runs[0].equals(runs[1])  # reruns agree
    got = runs[0].assign(taken=lambda p: p["size"] * p.copies).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((got.taken - got.target).abs() <= 0.01 * got.target).all() and runs[0].copies.max() <= 2


def same_rows(spark, n):
    one = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d e f").alias("text"), F.lit("s").alias("source"), "id")
    other = spark.range(3000).select("id", F.lit("a b c d e f g h").alias("text")).select((F.col("id") + 5).alias("doc_id"), "text", F.lit("t").alias("source"), "id")
    return one.unionByName(other).unionByName(spark.range(40).select(F.lit(2).cast("long").alias("doc_id"), F.lit("x y z").alias("text"), F.lit(None).cast("string").alias("source"), "id"))


@pytest.mark.parametrize("share", [0.2, 0.45, 0.9])
def test_rows_that_are_the_same(spark, share):
    """Of a thousand rows with one id and text as many are taken as the target has room for; twice alike."""
    docs = same_rows(spark, 1000)
    for rows in (docs, docs.repartition(7)):
        got = mixing.mix(rows, share=share, weights=(1, 3, 1)).groupBy("row.source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.count("*").alias("n"), F.max("copies").alias("most"), F.max("size").alias("size")).collect()
        assert {r.source: r.n for r in got} == {"s": 1000, "t": 3000, None: 40}
        assert all(abs(r.taken - r.target) < max(r["size"], 0.01 * r.target) and r.taken <= r.target and r.most <= 2 for r in got), got


def test_documents_larger_than_what_is_left(spark):
    """The search goes on as long as something fits, however many documents are too large."""
    sizes = [4000] * 30 + [1700] * 40 + [900] * 30 + [333] * 60 + [50] * 40 + [7] * 400
    docs = spark.createDataFrame([(i, "x", "a", s) for i, s in enumerate(sizes)], "doc_id long, text string, source string, n long")
    for share in (0.003, 0.03, 0.31, 0.62):
        got = mixing.mix(docs, size=docs.n, share=share).agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).first()
        assert 0 <= got.target - got.taken <= max(0.002 * got.target, 7)


def test_targets_of_many_sources(spark):
    sizes = {f"s{i}": i * 7919 % 1000 for i in range(700)} | {None: 50, "": 3}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mixing.many_targets(table, (5, 2, 1), 1.5, 2.0).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [got[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0).tolist())
    assert mixing.many_targets(table.where("false"), (1,), 1.5, 2.0).count() == 0


def test_pareto_inclusion_goes_with_the_odds(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 10 == 0, "big").otherwise("small").alias("source"), F.when(F.col("id") % 2 == 0, 16).otherwise(1).alias("n"))
    got = mixing.mix(docs, size=docs.n, share=0.5, power=0.5).where("row.source = 'small'").groupBy("size").agg(F.avg("copies").alias("p")).collect()
    p = {r["size"]: r.p for r in got}
    assert p[16] == pytest.approx(min(1, 4 * p[1]), rel=0.2)


def test_mix_on_odd_documents(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and mixing.mix(nothing).count() == 0
    sizes = collections.Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r.row.text or "")) and 0 <= r.copies <= 2 and r.row.copies == "z"
        sizes[r.row.source] += r["size"]
    assert all(r.source_size == sizes[r.row.source] for r in got)
    many = mixing.mix(odd.withColumn("source", F.col("doc_id").cast("string")))
    assert many.count() == odd.count()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab'sé日 \n\t\xa0　\x1c.,<|>", max_size=24)), min_size=1, max_size=6))
def test_words_encode_as_whole_texts(tokenizer, ts):
    e = _encoder(tokenizer)
    ids, at = e.encode(pa.array(ts, pa.string()))
    for i, want in enumerate(e.whole([t or "" for t in ts])):
        assert ids[at[i] : at[i + 1]].tolist() == want.tolist()


def test_words_are_told_apart_by_their_bytes(tokenizer):
    a, b = ("".join("ab"[x] for x in bits) for bits in thue_morse(1024))
    ts = [a, b, f"x {a}", f"x {b}", "x" * 15, "x" * 16, "x" * 15 + "\x00", "x\x00", "x", "q" * 5000, "q" * 5000 + "r", " ".join(["w" * n for n in range(1, 40)])]
    for kept in (4, 1 << 12):
        e = Encoder(tokenizer, kept=kept)
        for _ in range(2):
            ids, at = e.encode(pa.array(ts))
            assert [ids[p:q].tolist() for p, q in zip(at, at[1:])] == [x.tolist() for x in e.whole(ts)]


_kept = {}


def _encoder(path):
    return _kept.setdefault(path, Encoder(path, kept=40))  # so small that it has to let words go


def want(tokenizer, end):
    e = Encoder(tokenizer)
    return [(r[0], np.append(e.whole([r[1] or ""])[0], end).astype("<u4"), r[1]) for r in odd_rows()]


def test_token_files_round_trip(odd, nothing, spark, tokenizer, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(odd, path, tokenizer, 0)
    rows = token_files.with_start(token_files.checksums(token_files.read_tokens(spark, path)), token_files.read_tokens(spark, path)).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in rows) and [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == collections.Counter((doc_id, len(ids), zlib.crc32(ids.tobytes())) for doc_id, ids, _ in want(tokenizer, 0))
    assert token_files.token_table(nothing, tokenizer).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_format(odd, spark, tokenizer, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_files.write_tokens(odd.repartition(2), path, tokenizer, encoding=encoding)
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            tokens = columns["tokens.list.element"]
            assert ("RLE_DICTIONARY" in tokens.encodings) is (encoding == "dictionary") and (("DELTA_BINARY_PACKED" in tokens.encodings) is (encoding == "delta"))
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    few = token_files.read_tokens(spark, path, 20, 40).select("doc_id", "n_tokens")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in few.collect()} == {20, 30, 31, 39, 40} and "GreaterThanOrEqual(doc_id,20)" in plan and "tokens" not in plan.split("ReadSchema")[1].split("\n")[0].replace("n_tokens", "")
    with pytest.raises(ValueError):
        token_files.write_tokens(odd, path + "x", tokenizer, encoding="plain")


@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
def test_balance(lengths):
    n = np.array(lengths)
    placed, sequences = packing.balance(n, 64, 1.0, 0.1)
    seen, filled = collections.defaultdict(list), collections.Counter()
    for doc, start, length, seq, offset in placed:
        assert offset == filled[seq] and length > 0
        filled[seq] += length
        seen[doc].append((start, start + length))
    assert all(v <= 64 for v in filled.values()) and len(filled) == sequences
    assert sequences <= -(-int((n % 64).sum()) // 64) + int((n // 64).sum())
    for i, size in enumerate(lengths):
        spans = sorted(seen[i])
        assert spans[0][0] == 0 and spans[-1][1] == size and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_balance_evens_out_cost():
    n = np.random.default_rng(0).integers(1, 800, 500)
    placed, sequences = packing.balance(n, 1024, 1.0, 1 / 256)
    cost = collections.Counter()
    for _, _, length, seq, _ in placed:
        cost[seq] += length + length**2 / 256
    worst = max(cost.values()) / (sum(cost.values()) / sequences)
    first_fit, room = collections.Counter(), [1024] * 600
    for length in n:
        s = next(i for i, r in enumerate(room) if r >= length)
        room[s] -= int(length)
        first_fit[s] += length + length**2 / 256
    assert worst < max(first_fit.values()) / (sum(first_fit.values()) / len(first_fit))


def test_packing_on_odd_documents(odd, nothing, tokenizer):
    got = packing.pack(odd, tokenizer).collect()
    ids = collections.Counter()
    for r in got:
        assert len(r.tokens) == r.length and zlib.crc32(np.array(r.tokens, "<u4").tobytes()) == r.ids_crc32
        ids[r.doc_id] += r.length
    expected = collections.Counter()
    for doc_id, own, _ in want(tokenizer, 1):
        expected[doc_id] += len(own)
    assert ids == expected
    at = collections.Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and packing.pack(nothing, tokenizer).count() == 0
    total = packing.padding(packing.pack(odd, tokenizer, with_tokens=False)).first()
    assert total.ids == sum(at.values()) and total.padding < 3 * 2048


def test_packing_keeps_little_between_tasks(tokenizer, monkeypatch):
    made = []
    monkeypatch.setattr(packing, "encoder", lambda *args: made.append(encoder(*args)) or made[-1])
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    encoder.cache_clear()
    letters = np.random.default_rng(5).integers(97, 123, (500, 900, 6), dtype=np.uint8)
    texts = [b" ".join(w.tobytes() for w in t).decode() for t in letters]
    texts += texts[:20]  # words that the table has dropped by then
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = pa.Table.from_batches(packing._pack(tokenizer, 1, 2048, 1.0, 1 / 2048, True)([rows])).to_pylist()
    ids = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] += r["tokens"]
    lib = Encoder(tokenizer).whole(texts)
    assert [ids[i] for i in range(len(texts))] == [[*x.tolist(), 1] for x in lib]
    table = made[-1].table
    assert sum(x.nbytes for x in (table.slots, table.h, table.start, table.size, table.stamp, table.pool)) < 24 << 20
    encoder.cache_clear()
