import collections

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import boosting, isolation, statistics
from tessera.llm.words import Runs, grams, pieces, split
from tests.llm.conftest import WORD, odd_rows, thue_morse

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é日\n\t \x0b\x1f|#.A", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(ts):
    w = split(pa.array(ts, pa.string()))
    hashes, seen = w.hashes(), {}
    for i, t in enumerate(ts):
        own = WORD.findall(t or "")
        assert [x.decode() for x in w.strings(i)] == own
        for word, h in zip(own, hashes[w.first[i] : w.first[i + 1]], strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_slices_and_pieces():
    a = pa.array(["x y", None, "zz", "", "q"]).slice(1, 4)
    assert [len(p) for _, p in pieces(a, 2)] == [2, 2] or sum(len(p) for _, p in pieces(a, 2)) == 4
    assert split(a).counts().tolist() == [0, 1, 0, 1] and grams(np.zeros(2, np.uint64), 3).size == 0


def test_hashes_tell_few_letters_apart():
    for n in (8, 64, 1024, 4096):
        words = ["".join("ab"[b] for b in bits) for bits in thue_morse(n)]
        assert len(set(split(pa.array([*words, words[0] + "a", words[0] + "\x00"])).hashes().tolist())) == 4
        lines = statistics.count(pa.array(["\n".join(words), "\n".join([words[0]] * 2), "\n".join(" ".join(w) for w in words)]))
        assert lines["n_dup_lines"].tolist() == [0, 1, 0]
        one, two = (np.array([11, 17], np.uint64)[np.array(bits)] for bits in thue_morse(n))
        assert (grams(one, n) != grams(two, n)).all()


def test_runs_are_the_same_wherever_they_are():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    h[150:280] = h[3:133]
    runs = Runs(h)
    for k in (1, 2, 3, 5, 8, 25, 50, 77):
        every = runs.all(k)
        assert (every[150 : 280 - k + 1] == every[3 : 133 - k + 1]).all() and len(set(every[:150].tolist())) == 150
        assert (runs.some(np.arange(every.size), np.full(every.size, k)) == every).all()


def expected(t):
    t = t or ""
    w = WORD.findall(t)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = [any(windows[tuple(w[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(w) - 5) + 1)) for i in range(len(w))] if len(w) < 2000 else []
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_chars": len(t), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": sum(covered), "n_distinct_words": len(set(w)), "top_word": max(collections.Counter(w).values(), default=0), "n_lines": t.count("\n") + 1}


@settings(max_examples=60, deadline=None)
@given(texts)
def test_counts(ts):
    got = statistics.count(pa.array(ts, pa.string()))
    for i, t in enumerate(ts):
        assert {k: int(got[k][i]) for k in expected(t)} == expected(t)


def test_base_rules_on_odd_documents(odd, labels, nothing):
    got = isolation.judge(odd, labels).collect()
    assert len(got) == odd.count()
    by_id = {r.row.doc_id: r for r in got if r.row.doc_id}
    for row in odd_rows():
        if row[0] and row[0] != 70:
            e = expected(row[1])
            r = by_id[row[0]]
            assert {k: r[k] for k in e} == e
            assert r.base_failed == (e["n_words"] < 10 or 100 * e["n_repeat_words"] > 20 * e["n_words"]) and not (r.base_failed and r.kept)
    assert isolation.judge(odd, None).where("kept = base_failed").count() == 0
    assert isolation.judge(nothing, labels).count() == 0 and isolation.judge(odd, labels.where("false")).count() == len(got)


def test_isolation_forest_finds_anomalies(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(size=(1900, 4)), rng.normal(size=(100, 4)) * 0.2 + np.array([6, -6, 6, 6])
    x, y = np.vstack([good, bad]), np.append(np.ones(1900), np.zeros(100))
    forest = isolation.grow(x)
    score = forest.score(x)
    scored = lambda flags: spark.createDataFrame(list(zip(score.tolist(), flags.tolist())), "score double, good boolean").repartition(3)
    t = isolation.calibrate(scored(y == 1), 0.005)
    assert (score[y == 0] > t).mean() > 0.9 and (score[y == 1] > t).mean() <= 0.006 and t in score
    assert isolation.calibrate(scored(rng.random(2000) < 0.5), 0.01) == np.inf  # labels that do not bear anomalies out
    assert isolation.calibrate(scored(y > 5), 0.01) == isolation.calibrate(scored(y >= 0), 0.01) == np.inf


def path(forest, t, row):
    """By hand: the length of a row's path in a tree."""
    at, level = 0, 0
    while level < forest.depth and np.isfinite(forest.split[t, at]):
        at, level = 2 * at + 1 + int(row[forest.feature[t, at]] > forest.split[t, at]), level + 1
    return forest.length[t, at]


def test_paths_and_verdicts_by_hand(spark, odd, labels):
    x = np.random.default_rng(4).normal(size=(300, 11))
    forest = isolation.grow(x, trees=20, rows=64)
    h = 2 * (np.log(63) + 0.5772156649015329) - 2 * 63 / 64
    want = [2 ** -(np.mean([path(forest, t, row) for t in range(20)]) / h) for row in x[:40]]
    assert np.allclose(forest.score(x[:40]), want)
    texts = [r[1] for r in odd_rows()]
    for keep in (False, True):
        got = isolation.judge(odd, labels, keep_text=keep).collect()
        assert all(r.kept is (not r.base_failed) or (r.anomaly > 0 and not r.base_failed) for r in got)
        if keep:
            assert sorted(r.text or "" for r in got) == sorted(t or "" for t in texts)


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    m = boosting.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    assert np.allclose(m.raw(x[:7]), [m.raw(row[None])[0] for row in x[:7]])
    assert boosting.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_on_labelled_documents(spark, sf):
    import zlib

    d, table = sf
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = boosting.classify(docs, labels).select("row.doc_id", "score", boosting.held_out(boosting.F.col("row.doc_id")).alias("held")).join(labels, "doc_id").toPandas()
    assert (got.held == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    own = got[got.held]
    assert (((own.score >= 0.3) == (own.quality == 1)).mean()) > 0.97


def test_classifier_on_odd_documents(odd, labels, nothing):
    got = boosting.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and "text" not in got[0].row
    assert boosting.classify(nothing, labels).count() == 0 and {r.score for r in boosting.classify(odd, labels.where("false")).collect()} == {0.5}


def test_samples_for_fitting(spark):
    """Those of least hash of their id, as many as asked for; of an id with a third of all rows, and of rows that repeat, no more."""
    hot = "CASE WHEN id % 3 = 0 THEN 7 ELSE id END"
    counts = [F.expr(f"CASE WHEN id % 2 = 0 THEN 1 ELSE id END + {i}").cast("long").alias(c) for i, c in enumerate(statistics.COUNTS)]
    rows = spark.range(9000).repartition(7).select(F.expr(hot).alias("label_of"), (F.col("id") % 2).cast("double").alias("label"), *counts).withColumn("order", F.xxhash64("label_of"))
    held = rows.toPandas().sort_values("order")
    before = int((held.order < held[held.label_of == 7].order.iloc[0]).sum())
    for most in (1, 50, before, before + 10, before + 2000, 8999, 9000, 10_000):
        x, y = boosting.sample(rows, most)
        assert x.shape == (min(most, 9000), len(statistics.RATES)) and y.shape == (min(most, 9000),)
        if most <= before or most >= 9000:  # the same rows as by a sort of all
            want = held.iloc[:most]
            assert np.allclose(np.sort(x[:, 0]), np.sort(np.log1p(want.n_words.to_numpy(float)))) and y.sum() == want.label.sum()
        again = boosting.sample(rows.repartition(3), most)
        assert (again[0] == x).all() and (again[1] == y).all()
    assert boosting.sample(rows.where("false"), 5)[0].shape[0] == 0
