import collections
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import collisions, lm, secrets, trigrams
from tests.llm.conftest import WORD, odd_rows


def models(target, back, order):
    """By brute force: counts of n-grams, each text between marks, and the probability of a word after a history."""
    grams = []
    for texts in (target, back):
        c = collections.Counter()
        for t in texts:
            seq = ["<>", *WORD.findall(t or ""), "<>"]
            for i in range(1, len(seq)):
                c.update(tuple(seq[j : i + 1]) for j in range(max(0, i - order + 1), i + 1))
        grams.append(c)
    words = {g for c in grams for g in c if len(g) == 1}

    def p(m, history, word, less):
        count = lambda g: grams[m][g] - less[g]
        if not history:
            tokens = sum(n for g, n in grams[m].items() if len(g) == 1) - sum(n for g, n in less.items() if len(g) == 1)
            return (count((word,)) + lm.ADDED) / (tokens + lm.ADDED * (len(words) + 1))
        lower = p(m, history[1:], word, less)
        return lm.WEIGHT * count((*history, word)) / count(history) + (1 - lm.WEIGHT) * lower if count(history) > 0 else lower

    return words, p


def losses(target, back, order, text, left_out):
    words, p = models(target, back, order)
    less = [collections.Counter(), collections.Counter()]
    seq = ["<>", *WORD.findall(text or ""), "<>"]
    if left_out:
        for i in range(1, len(seq)):
            less[1].update(tuple(seq[j : i + 1]) for j in range(max(0, i - order + 1), i + 1))
    return len(seq) - 1, *[np.mean([-math.log(p(m, tuple(seq[max(0, i - order + 1) : i]), seq[i], less[m])) for i in range(1, len(seq))]) for m in (0, 1)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_losses_are_those_of_the_counts(spark, order):
    target, back = ["a b a b c", "a b", None], ["c c c d", "b a d c", "a b c d e", "a b c d e", "", "only here", "a"]
    df = lambda ts: spark.createDataFrame([(i, t, "k") for i, t in enumerate(ts)], "doc_id long, text string, score string").repartition(3)
    words, p = models(target, back, order)
    for history in ((), ("a",), ("zzz",), ("a", "b"))[: order + 1]:
        for m in (0, 1):
            every = sum(p(m, history[-(order - 1) :] if order > 1 else (), w, collections.Counter()) for (w,) in [*words, ("zzz",)])
            assert every == pytest.approx(1)
    shown = ["a b zzz c", None, "", "c d e a b", "b", *back]
    for r in lm.cross_entropy_difference(df(shown), df(target), df(back), order=order).collect():
        want = losses(target, back, order, shown[r.row.doc_id], False)
        assert (r.n_tokens, r.target_loss, r.background_loss, r.score) == pytest.approx((*want, want[1] - want[2])) and r.row.score == "k"
    for r in lm.cross_entropy_difference(df(back), df(target), order=order, block_bytes=1).collect():
        assert (r.n_tokens, r.target_loss, r.background_loss) == pytest.approx(losses(target, back, order, back[r.row.doc_id], True))


def test_rare_words_and_pairs_count_in_large_corpora(spark):
    rng = np.random.default_rng(5)
    passages = [f"rare{i} w{i} w{2 * i} seldom{i} once{i % 3}" for i in range(40)]
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.3, 1000) % 4000) for _ in range(200)]
    back = [f"{t} {passages[i % 40]}" if i < 80 else t for i, t in enumerate(texts)]
    target = [" ".join(f"w{int(w)}" for w in rng.integers(0, 900, 50)) for _ in range(300)] + [None, "", "lonely1 lonely2", "lonely1 lonely3"]
    df = lambda ts: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string").repartition(3)
    shown = [*passages, None, "new1 new2 w3 rare1 new4", target[3]]
    got = {r.row.doc_id: r for r in lm.cross_entropy_difference(df(shown), df(target), df(back), block_bytes=1 << 18, part_bits=7).collect()}
    for i in (0, 39, 40, 41, 42):
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx(losses(target, back, 2, shown[i], False)[1:])
    twice = ["unheard " + " ".join(f"x{i}y{j}" for j in range(30)) for i in range(5)]
    once = ["unseen " + " ".join(f"q{i}z{j}" for j in range(30)) for i in range(5)]
    own = {r.row.doc_id: r.background_loss for r in lm.cross_entropy_difference(df([*twice, *twice, *once, *back]), df(target)).collect()}
    assert max(own[i] for i in range(10)) + 3 < min(own[i] for i in range(10, 15))  # what occurs twice is known, what occurs once is not


def test_scores_tell_the_target(spark, sf):
    _, table = sf
    docs = table("documents").select("doc_id", "text", "lang")
    got = lm.cross_entropy_difference(docs, docs.where("lang = 'fr'")).groupBy(F.col("row.lang") == "fr").agg(F.avg("score")).collect()
    means = {r[0]: r[1] for r in got}
    assert means[True] < means[False] - 1


def test_scores_of_odd_documents(odd, nothing):
    got = lm.cross_entropy_difference(odd, odd.where("doc_id < 10")).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert lm.cross_entropy_difference(nothing, odd).count() == 0
    assert all(math.isfinite(r.score) for r in lm.cross_entropy_difference(odd, nothing).collect())


ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])


TRICKY = [
    "token=secret: abcdefghijklmnop", "PassWord='aaaaaaaaaaaa' api_key = x api-key=abcdefghijkl", "AKIAAKIA" + "A" * 14 + " AKIAshort AKIA" + "9" * 13, "é日 secret:0123456789abcdef0123 x", "deadbeef" * 2 + "g" + "0" * 15,
    "\x01\x02token=abcdefghijklmn\x01 \x02\x03 0123456789abcdef\x02", "token==abcdefghijkl", "tokentoken : \"abcdefghijklm\"", "", "x" * 5000 + " passwd=" + "q" * 5000, "a$1b\\1 secret=abcd$efghijklmnop",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9 + " xoxb-1234567890ab eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMe", "\U0001f511 token = abcdefabcdefabcdef",
]


def test_secret_spans(spark, odd, nothing):
    rows = [(i, t) for i, t in enumerate([*TRICKY, *TRICKY[:2], None])]
    got = {r.row.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert [(s.start, s["rank"], s.end) for s in got[i].spans if s["rank"] < 3] == base_spans(t or ""), t
    assert {s["rank"] for s in got[11].spans} >= {3, 4, 5, 6}
    for r in secrets.scan(odd).collect():
        assert [(s.start, s["rank"], s.end) for s in r.spans if s["rank"] < 3] == base_spans(r.text) and r.row.spans == "z"
    assert secrets.scan(nothing).count() == 0 and secrets.scan(odd).count() == len(odd_rows())


PUBLIC = [
    (r"AIza[0-9A-Za-z_-]{35}", "AIza" + "b" * 35), (r"sk_live_[0-9a-zA-Z]{24}", "sk_live_" + "9" * 24), (r"npm_[A-Za-z0-9]{36}", "npm_" + "Q" * 36), (r"(?i)aws_secret|https?://", "HTTPS://x"), (r"https?://[^/\s]+:[^@\s]+@", "http://u:p@"),
    (r"ya29\.[0-9A-Za-z_-]+", "ya29.abc"), (r"SG\.[\w-]{22}\.[\w-]{43}", "SG." + "a" * 22 + "." + "b" * 43), (r"(?:abc){2,}x?", "abcabcabc"), (r"\bkey\s*=", "key ="), (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "123-45-6789"), (r"[a-c][d-f]g", "aFg".lower()), (r"(ab|cd)+(?=e)ef", "abcdef"),
]


def test_trigrams_are_derived_from_patterns():
    assert trigrams.query_of(secrets.ACCESS) == ("and", ("aki", "kia")) and trigrams.query_of(secrets.HEX) == trigrams.ALL == trigrams.query_of(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
    assert {"ike", "_ke", "swo", "swd"} <= trigrams.trigrams_of(trigrams.query_of(secrets.ASSIGN))
    for pattern, text in PUBLIC:
        low = text.lower()
        have, query = {low[i : i + 3] for i in range(len(low) - 2)}, trigrams.query_of(pattern)
        assert re.search(pattern, text) and trigrams.meets(query, have) and (query == trigrams.ALL or trigrams.heads(query) & have), pattern
    assert sum(trigrams.query_of(p) != trigrams.ALL for p, _ in PUBLIC) >= 10
    assert trigrams.query_of("(") == trigrams.query_of("x[a[b]]yzw") == trigrams.query_of("a*") == trigrams.ALL  # beyond the parser, or nothing mandatory


ATOMS = st.one_of(st.sampled_from(["a", "b", "C", "abc", "ca", "[ab]", "[^a]", ".", r"\w", "x?", "(ab|c)", "(?:bc)+", "(?i:cab)", "a{2,3}", "(?:a|bc)?", "^", "$", "é"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(ATOMS, min_size=1, max_size=6), st.text("abcCxé", max_size=14))
def test_no_match_without_its_trigrams(atoms, text):
    pattern, low = "".join(atoms), text.lower()
    if re.search(pattern, text):
        assert trigrams.meets(trigrams.query_of(pattern), {low[i : i + 3] for i in range(len(low) - 2)})


def test_index(spark):
    rows = [(str(i), t) for i, t in enumerate(["a password b", "pass word ssw swo", "AKIA", "kia aki", "none", "api_key", "apikey", "api key", "wor ord passw swo"])]
    docs = spark.createDataFrame(rows, "key string, text string")
    for n in (1, 100_000):  # one block, and many
        hits = {r.key: set(r.kinds) for r in secrets.candidates(docs, secrets.BASE, n).collect()}
        assert hits == {"0": {"assign"}, "1": {"assign"}, "2": {"access"}, "3": {"access"}, "5": {"assign"}, "6": {"assign"}, "8": {"assign"}}


def test_rules_given_a_pattern_alone(spark):
    rules = tuple(secrets.Rule(f"r{i}", p, 0) for i, (p, _) in enumerate(PUBLIC))
    rows = [(i, f"x {t} y") for i, (_, t) in enumerate(PUBLIC)] + [(99, None), (98, "nothing")]
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect():
        want = sorted((m.start(), i, m.end()) for i, (p, _) in enumerate(PUBLIC) for m in re.finditer(p, dict(rows)[r.row.doc_id] or ""))
        assert [(s.start, s["rank"], s.end) for s in r.spans] == want, r


def test_very_many_matches_in_a_text(spark):
    text = " ".join(f"{i:016x}" for i in range(5000))
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(s.start, s.end) for s in got] == [(17 * i, 17 * i + 16) for i in range(5000)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"x token = {'ab12' * 6} y {'0f' * 10}é")], "doc_id long, text string")
    assert secrets.redact(secrets.scan(df)).first().text == "x [SECRET] y [SECRET]é"


def test_secrets_run_without_python(spark, odd):
    plan = secrets.redact(secrets.scan(odd))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def nearest(ids, x, query, k):
    score = x @ x[query]
    order = np.lexsort((ids, -score))
    return [i for i in order if ids[i] != ids[query]][:k], score


def searched(spark, x, block, least, share=1.0):
    """Search every 20th of x in blocks of that size; recall, and scores, against brute force."""
    x = np.float32(x)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(float)
    got = collisions.search(df, F.col("vec_id") % 20 == 0, block=block).toPandas()
    queries = range(0, len(x), 20)
    assert (got.groupby("query_id").size() == 20).all() and set(got.query_id) == set(queries)
    hit = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        want, score = nearest(np.arange(len(x)), x, q, 20)
        hit += len(set(want) & set(own.vec_id))
        assert np.allclose(own.score, score[own.vec_id], rtol=0, atol=1e-9) and q not in set(own.vec_id)
        assert own["rank"].tolist() == list(range(1, 21)) and own.vec_id.tolist() == [v for _, v in sorted(zip(-own.score, own.vec_id))]
    assert hit / (20 * len(queries)) >= least
    assert got.groupby("query_id").verified.first().mean() <= share * len(x)
    return got


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))  # of different lengths
    x[100] *= 3 / np.linalg.norm(x[100]) * np.sqrt(24)
    x[101:131] = x[100]  # ties
    for block in (collisions.BLOCK, 700):
        got = searched(spark, x, block, 0.95)
        assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(101, 121))


def test_search_in_many_blocks(spark):
    """Clustered vectors: few blocks are gone to, and few vectors verified.  The same share of vectors without structure is in reach of every query, so most are."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 48))
    x = centres[rng.integers(0, 300, 21_000)] + 0.25 * rng.normal(size=(21_000, 48))
    searched(spark, x, 2048, 0.95, 0.1)
    searched(spark, rng.normal(size=(5000, 32)), 1024, 0.9)


def test_search_of_one_very_common_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16))
    x[1000:3000:2] = x[1000] = 2 * np.abs(x[1000])
    got = searched(spark, x, 256, 0.95)
    assert got[got.query_id == 1500].sort_values("rank").vec_id.tolist() == list(range(1000, 1040, 2))
    assert got[got.query_id == 1000].sort_values("rank").vec_id.tolist() == list(range(1002, 1042, 2))


def test_search_of_the_tables(spark):
    import __spark_entry__ as entry

    for sf in ("sf0.001", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
        x, got = np.stack(rows.embedding.to_list()).astype(float), entry.queries()["op8_collision_search"](spark, f"/root/testdata/{sf}").toPandas()
        hit = sum(len(set(rows.vec_id.to_numpy()[nearest(rows.vec_id.to_numpy(), x, int(np.searchsorted(rows.vec_id, q)), 20)[0]]) & set(own.vec_id)) for q, own in got.groupby("query_id"))
        assert hit / len(got) >= 0.95 and len(got) == 20 * (rows.vec_id % 20 == 0).sum()


def test_search_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [2.0, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.0, 0.0])]
    clashes = [F.lit("z").alias(c) for c in "id vec q turn dim cell block kind bound near of verified query_id rank score".split()]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *clashes)
    got = collisions.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 8, 2.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (20, 1, 8, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 0.5)]
    assert collisions.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


def test_windows_hold_what_is_in_reach():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    family = collisions.Family(float(np.sqrt((x**2).sum(1)).max()), functions=32)
    index = collisions.Index(np.arange(400), x, family)
    shadow = family.query_shadows(x[:3])
    want = (np.abs(family.shadows(x)[None] - shadow[:, None]) <= 0.7).sum(2)
    assert (index.counts(shadow, np.full(3, 0.7)) == want).all()


def test_words_pattern():
    assert WORD.findall("a\x1cb c") == ["a\x1cb", "c"]
