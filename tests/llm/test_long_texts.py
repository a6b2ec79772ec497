"""Texts of megabytes, which are beyond the size of the pieces that texts are worked on in: whole, and beside short ones."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bagminhash, boosting, isolation, lm, mixing, packing, secrets, substring, token_files
from tests.llm.conftest import WORD, prose
from tests.llm.test_models import base_spans

LONG = prose(450_000, 71, 200_000)
PASSAGE = prose(60, 72)
SECRET = f'token = "{"q7" * 9}" AKIA{"B" * 16}'
TEXTS = {1: "a few words here", 2: f"{LONG} {PASSAGE} end", 3: f"start {LONG}", 4: f"{PASSAGE} {prose(30, 73)}", 5: f"{prose(800_000, 74, 3)}\n{SECRET}\n{SECRET}", 6: None}


@pytest.fixture(scope="module")
def long(spark):
    assert all(len(TEXTS[i]) > (1 << 21) for i in (2, 3, 5))
    return spark.createDataFrame([(i, t, "s") for i, t in TEXTS.items()], "doc_id long, text string, source string").repartition(2)


def test_words_and_counts(long):
    got = {r.row.doc_id: r for r in isolation.judge(long, None).collect()}
    for i, t in TEXTS.items():
        words = WORD.findall(t or "")
        assert (got[i].n_words, got[i].word_chars) == (len(words), sum(map(len, words)))
    assert got[5].n_dup_lines == 1 and got[5].n_repeat_words >= 799_000 and got[5].base_failed and got[2].kept
    sizes = {r.row.doc_id: r for r in mixing.mix(long).collect()}
    assert all(sizes[i].size == len(WORD.findall(t or "")) and 0 <= sizes[i].copies <= 2 for i, t in TEXTS.items())


def test_passages_and_copies(long):
    docs = long.where("doc_id <> 5")
    got = {r.row.doc_id: r for r in substring.remove_repeated(docs).collect()}
    n = len(WORD.findall(LONG))
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 0, 3: n, 4: 60, 6: 0}
    assert got[3].kept_text == "start" and got[4].kept_text == TEXTS[4][len(PASSAGE) + 1 :] and got[2].kept_text == TEXTS[2]
    assert {r.doc_id: r.class_id for r in bagminhash.near_classes(long).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}


def test_tokens_and_pieces(long, tokenizer):
    whole = Tokenizer.from_file(tokenizer)
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in TEXTS.items()}
    at = 0
    for r in token_files.token_table(long, tokenizer, end=0).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, ids[r.doc_id].size, zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    pieces = packing.pack(long, tokenizer, capacity=2048, end=0, with_tokens=False).orderBy("doc_id", "start").collect()
    for i, own in ids.items():
        at = 0
        for r in (r for r in pieces if r.doc_id == i):
            assert r.start == at and r.length <= 2048 and r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == own.size


def test_secrets_and_scores(long):
    for r in secrets.scan(long).collect():
        want = base_spans(TEXTS[r.row.doc_id] or "")
        assert [(s.start, s.rank, s.end) for s in r.spans if s["rank"] < 3] == [tuple(x) for x in want] and (len(want) >= 4) is (r.row.doc_id == 5)
    scores = {r.row.doc_id: r.score for r in lm.cross_entropy_difference(long.select("doc_id", "text"), long.where("doc_id = 4").select(F.col("text"))).collect()}
    assert len(scores) == len(TEXTS) and all(s is None or np.isfinite(s) for s in scores.values())
    labels = long.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert all(0 <= r.score <= 1 for r in boosting.classify(long.select("doc_id", "text"), labels).collect())
