import collections
import itertools

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bagminhash, substring
from tessera.llm.graph import components
from tests.llm.conftest import WORD, odd_rows, prose, thue_morse


def removed(rows, length):
    """By brute force: (id, text) -> kept words."""
    first = {}
    last = 1 << 63
    for i, t in rows:
        w = WORD.findall(t or "")
        for a in range(len(w) - length + 1):
            key = tuple(w[a : a + length])
            first[key] = min(first.get(key, last), last - 1 if i is None else i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < (last - 1 if i is None else i):
                gone[a : a + length] = [True] * length
        out[i, t] = [x for x, g in zip(w, gone) if not g]
    return out


@pytest.mark.parametrize("length", [50, 7])
def test_repeated_passages(odd, nothing, length):
    rows = [r[:2] for r in odd_rows()]
    want = collections.Counter((i, len(WORD.findall(t or "")), " ".join(removed(rows, length)[i, t])) for i, t in rows)
    got = substring.remove_repeated(odd, words=length).collect()
    assert collections.Counter((r.row.doc_id, r.n_words, r.kept_text) for r in got) == want
    assert all(r.n_removed == r.n_words - len(r.kept_text.split()) == sum(b - a for a, b in r.removed) for r in got) and any(r.n_removed for r in got)
    assert substring.remove_repeated(nothing).count() == 0


def test_passages_in_many_neighbourhoods(spark):
    """A passage that most documents share, cut off at either side in turn, within other shared text."""
    passage = prose(90, 5).split()
    rows = []
    for i in range(120):
        cut = passage[i % 23 : 90 - i % 17]
        rows.append((i * 7 % 120, " ".join([*prose(i % 11, i).split(), *cut, *prose(i % 5, 100 + i % 4).split()])))
    got = {r.row.doc_id: r.kept_text for r in substring.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: " ".join(k) for (i, _), k in removed(rows, 50).items()}


def test_passages_of_few_letters(spark):
    """Words, and windows, whose polynomials agree are told apart."""
    a, b = (" ".join("ab"[x] for x in bits) for bits in thue_morse(128))
    one, two = ("".join("ab"[x] for x in bits) for bits in thue_morse(1024))
    rest = prose(49, 77)
    rows = [(1, a), (2, b), (3, f"{one} {rest}"), (4, f"{two} {rest}"), (None, prose(61, 78)), (None, prose(80, 79)), (None, prose(80, 79))]
    got = sorted(((r.row.doc_id or 99, r.kept_text) for r in substring.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted((i or 99, " ".join(removed(rows, 50)[i, t])) for i, t in rows)
    near = {r.doc_id: r.class_id for r in bagminhash.near_classes(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()}
    assert near == {1: 1, 2: 2}


def similarity(x, y):
    both = sum((x & y).values())
    return both / max(sum(x.values()) + sum(y.values()) - both, 1)


def bag(t):
    w = WORD.findall(t or "")
    return collections.Counter(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else None


def classes(rows):
    """By brute force: id -> least id of the class."""
    texts = {i: bag(t) for i, t in rows}
    of = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if texts[a] and texts[b] and of[a] != of[b] and similarity(texts[a], texts[b]) >= 0.8:
            low, high = sorted((of[a], of[b]))
            of = {i: low if c == high else c for i, c in of.items()}
    return of


def test_near_classes_of_odd_documents(odd, nothing):
    rows = [r[:2] for r in odd_rows()]
    got = {r.doc_id: r.class_id for r in bagminhash.near_classes(odd).collect() if r.doc_id is not None}
    assert got == classes([r for r in rows if r[0] is not None])
    assert bagminhash.near_classes(nothing).count() == 0
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns and bagminhash.keep_one(nothing).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(got.values())) and ids.count(None) == 1  # a null text; the others have near copies with ids


def test_groups_of_copies(spark):
    """A large group around a common origin, another without one, chains, and unlike documents that share a passage."""
    rng = np.random.default_rng(0)
    base, rows = prose(200, 50).split(), []

    def edited(words, share, seed):
        r = np.random.default_rng(seed)
        return [f"e{r.integers(1 << 30)}" if r.random() < share else w for w in words]

    rows.append((1000, " ".join(base)))
    rows += [(i, " ".join(edited(base, s, i))) for i, s in enumerate(rng.uniform(0.002, 0.05, 150))]
    other = prose(200, 51).split()
    rows += [(2000 + i, " ".join(edited(other, 0.02, 5000 + i))) for i in range(60)]
    chain = prose(200, 52).split()
    for i in range(12):
        chain = edited(chain, 0.012, 9000 + i)
        rows.append((3000 + i, " ".join(chain)))
    shared = prose(60, 53)
    rows += [(4000 + i, f"{shared} {prose(60, 600 + i)}") for i in range(60)]
    got = {r.doc_id: r.class_id for r in bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == classes(rows)


def test_bucket_of_unlike_members(spark, monkeypatch):
    """Many unlike documents that share a passage, with a few near copies among them: rows that are compared grow with the members, and no link is lost."""
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    seen, inner = [], bagminhash._dealt
    monkeypatch.setattr(bagminhash, "_dealt", lambda m, s: seen.append(inner(m, s)) or seen[-1])
    shared = prose(90, 60)
    for n in (120, 240):
        rows = [(i, f"{shared} {prose(50, 7000 + i)}") for i in range(n)]
        rows += [(9000 + i, rows[i][1] + " and more") for i in range(0, n, 10)]
        seen.clear()
        got = {r.doc_id: r.class_id for r in bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bands=64).collect()}
        assert got == classes(rows)
        assert len(seen) == 2 and sum(d.count() for pair in seen for d in pair) < 40 * len(rows), n


def test_different_texts_with_one_id(spark):
    rows = [(1, prose(80, 1)), (1, prose(80, 2)), (1, prose(80, 2)), (2, prose(80, 3)), (3, prose(80, 3)), (4, prose(80, 2)), (None, prose(80, 9)), (None, None), (5, None), (6, " ")]
    kept = bagminhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.text for r in kept} == {t for _, t in rows} and len(kept) == 7 and {r.doc_id for r in kept if r.text == prose(80, 3)} == {2}
    got = collections.Counter((r.doc_id, r.class_id) for r in bagminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[2, 2] == got[3, 2] == got[5, 5] == got[6, 6] == 1 and got[1, 1] + got[1, 4] == 2 and got[4, 1] + got[4, 4] == 1 and got[4, 1] == (got[1, 1] == 2) and got[None, None] == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for trial in range(5):
        a = rng.integers(0, 6, 80) * rng.integers(0, 3, 80)
        b = np.maximum(a + rng.integers(-2, 3, 80), 0)
        sigs = []
        for w in (a, b):
            at = np.flatnonzero(w)
            sigs.append(bagminhash.signatures(bagminhash.Bags(bagminhash.mix(at.astype(np.uint64) + np.uint64(trial * 1000 + 1)), w[at], np.zeros(at.size, int), np.array([0, at.size])), 4096))
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sigs[0] == sigs[1]).mean() - j) < 4 * np.sqrt(j * (1 - j) / 4096)


def test_signatures_do_not_depend_on_their_neighbours():
    texts = ["a b c d e f g", "", "x " * 300, "p q"]
    together = bagminhash.signatures(bagminhash.bags(pa.array(texts)), 64)
    assert np.isinf(together[1]).all()
    for i in (0, 2, 3):
        assert (together[i] == bagminhash.signatures(bagminhash.bags(pa.array([texts[i]])), 64)[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 150, 150: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
