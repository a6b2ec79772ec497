"""Every registered query on a whole table: its columns, their types, and what its contract fixes."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.llm import mixing
from tessera.llm.tokens import Encoder
from tests.conftest import DATA
from tests.llm.conftest import WORD
from tests.llm.test_duplicates import classes, removed
from tests.llm.test_models import base_spans
from tests.llm.test_text_counts import expected

QUERIES = {n.partition("_")[0]: q for n, q in entry.queries().items() if n.startswith("op") and n[2].isdigit()}
COLUMNS = {
    "op1": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4": "doc_id bigint, score double",
    "op5": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8": "query_id bigint, rank int, vec_id bigint, score double",
    "op9": "doc_id bigint, class_id bigint",
    "op10": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}
_seen = {}


def rows(spark, op):
    if op not in _seen:
        df = QUERIES[op](spark, DATA)
        _seen[op] = dict(df.dtypes), df.collect()
    return _seen[op][1]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("op", COLUMNS)
def test_columns(spark, op, docs):
    got = rows(spark, op)
    types = _seen[op][0]
    assert {c: types.get(c) for c in (x.split()[0] for x in COLUMNS[op].split(", "))} == dict(x.split() for x in COLUMNS[op].split(", "))
    if op not in ("op5", "op8"):
        assert sorted(r.doc_id for r in got) == sorted(docs)


def test_mix(spark, docs):
    got = rows(spark, "op1")
    size = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    total, taken = collections.Counter(), collections.Counter()
    for i, d in docs.items():
        total[d.source] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    for r in got:
        source = docs[r.doc_id].source
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], total[source], pytest.approx(target[source])) and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
    for s in order:  # near the target, or no document is left that would still fit
        left, whole = target[s] - taken[s], target[s] // total[s]
        more = [r.size for r in got if docs[r.doc_id].source == s and r.size and r.taken <= whole * r.size]
        assert -1e-6 <= left and (left <= 0.002 * target[s] or left < min(more))


def test_removal(spark, docs):
    want = removed([(i, d.text) for i, d in docs.items()], 50)
    for r in rows(spark, "op2"):
        kept = want[r.doc_id, docs[r.doc_id].text]
        n = len(WORD.findall(docs[r.doc_id].text or ""))
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), sha(" ".join(kept)))


def test_tokens_and_pieces(spark, docs, tokenizer):
    e, at = Encoder(tokenizer), 0
    ids = {i: e.whole([docs[i].text or ""])[0] for i in sorted(docs)}
    for r in sorted(rows(spark, "op3"), key=lambda r: r.doc_id):
        own = np.append(ids[r.doc_id], 0).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, own.size, zlib.crc32(own.tobytes()))
        at += own.size
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows(spark, "op5"):
        own = np.append(ids[r.doc_id], 1).astype("<u4")
        assert r.doc_tokens == own.size and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for of in (pieces, sequences):
        for own in of.values():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: x.size + 1 for i, x in ids.items()}
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert max(used) <= 2048 and sum(0 if n & (n - 1) == 0 else 2048 - n for n in used) <= 0.02 * sum(used) + 2048


def test_quality(spark, docs):
    held = {r.doc_id: r for r in rows(spark, "op6")}
    assert all(r.held_out is (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in held.items())


def test_secrets(spark, docs):
    kinds = ("assign", "access", "hex")
    for r in rows(spark, "op7"):
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in base_spans(docs[r.doc_id].text or "")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in kinds)
        assert r.base_sha256 == sha(",".join(base)) and set(base) <= set(r.spans.split(",")) | {""} and (base or not r.spans.startswith(kinds))


def test_classes(spark, docs):
    assert {r.doc_id: r.class_id for r in rows(spark, "op9")} == classes([(i, d.text) for i, d in docs.items()])


def test_rules(spark, docs):
    for r in rows(spark, "op10"):
        want = expected(docs[r.doc_id].text) if len(WORD.findall(docs[r.doc_id].text or "")) < 2000 else {}
        assert all(r[c] == want[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if want)
        assert r.base_failed is (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
