import os
import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, or give to their results.
CLASHES = "row size source_size target copies did node key at found spans n_words score kept class band tokens"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES.split() if c not in ("text", "source"))


def prose(n, seed, vocabulary=3000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def thue_morse(n):
    """Two sequences of n of two letters, one the other's complement, whose polynomials agree modulo 2 ** 64 for large n and any base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return bits, [1 - b for b in bits]


def odd_rows():
    """Nulls, empty and long texts, copies and near copies, shared passages, repeated rows."""
    passage, base = prose(70, 1), prose(300, 2)
    near = base.split()
    near[10], near[200] = "changed", "too"
    far = [w if i % 4 else "x" + w for i, w in enumerate(base.split())]
    texts = [
        prose(120, 10), None, "", " \n\t ", base, base, " ".join(near), " ".join(far), f"{prose(30, 11)} {passage} {prose(30, 12)}", f"{passage}\n{prose(40, 13)}", f"lead {passage}", "one two three",
        "one two three", " ".join(["again"] * 400), prose(20_000, 14), "é日本 “q” naïve ###  |x|\n\nline\nline\nline", f"a\x01b token = \"{'ab12' * 6}\" and AKIA{'Z' * 16}, {'0f' * 10} password:short secret: {'x' * 12}", "tab\tand\x0bvt\x0cff\rcr",
    ]
    ids = [5, 6, 7, 8, 20, 11, 30, 31, 40, 41, 39, 50, 51, 60, 70, 80, 90, 95]
    rows = [(i, t, "en", "a" if i < 40 else "b" if i < 60 else None, len(t or "")) for i, t in zip(ids, texts)]
    rows += [rows[0], rows[0], (None, base, None, "a", None), (None, None, None, None, None), (None, passage, None, "c", 1)]
    extra = len(SCHEMA.split(",")) - 5
    return [(*r, *["z"] * extra) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)] + [(5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf(spark):
    d = "/root/testdata/sf0.001"
    return d, lambda name: spark.read.parquet(f"{d}/{name}.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    from tessera.llm.queries import tokenizer_path

    path = tokenizer_path()
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    return path
