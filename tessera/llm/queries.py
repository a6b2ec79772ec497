"""The queries of this subpackage, registered by the driver entry."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bagminhash, boosting, collisions, isolation, lm, mixing, packing, secrets, substring, token_files


def tokenizer_path() -> str:
    """The vocabulary file; a parameter of every operator that encodes."""
    if own := os.environ.get("TESSERA_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("row.source").alias("source"), F.col("copies").cast("long").alias("copies"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), words=50)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), tokenizer_path(), end=0)


def op4_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by how much they read like the turns of conversations, against all documents."""
    scored = lm.cross_entropy_difference(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "conversations").select("text"))
    return scored.select("row.doc_id", "n_tokens", "target_loss", "background_loss", "score")


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end=1, with_tokens=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = boosting.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", boosting.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_base = len(secrets.BASE)
    base = F.filter("spans", lambda s: s["rank"] < n_base)
    counts = [secrets.number(F.col("spans"), i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return found.select("row.doc_id", *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op8_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = isolation.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mix of all documents each source's target, and whether what it gives lies within a hundredth, or the largest document, of that."""
    of = op1_pareto_mix(spark, sf_dir).groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("largest"))
    near = (F.col("taken") <= F.col("target")) & (F.col("target") - F.col("taken") <= F.greatest(F.col("target") / 100, F.col("largest")))
    return of.select("source", "source_size", F.round("target", 3).alias("target"), near.alias("near"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules count in each document, and the verdict of the base rules."""
    judged = isolation.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), None)
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict:
    of_contract = {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}
    return of_contract | {"mix_targets": mix_targets, "rule_counts": rule_counts}


_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

_REPEATS = f"""
WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
low AS (SELECT k, MIN(doc_id) AS d0 FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN low USING (k) WHERE d0 < win.doc_id)),
each AS (SELECT doc_id, j, ws[j] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (SELECT e.doc_id, COUNT(g.j) AS n_removed, string_agg(word, ' ' ORDER BY e.j) FILTER (WHERE g.j IS NULL) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_NEAR = f"""
WITH RECURSIVE {_WORDS},
shingles AS (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
bag AS (SELECT doc_id, k, COUNT(*) AS c FROM shingles GROUP BY ALL),
total AS (SELECT doc_id, SUM(c) AS n FROM bag GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, SUM(LEAST(a.c, b.c)) AS m FROM bag a JOIN bag b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN total s ON x = s.doc_id JOIN total t ON y = t.doc_id WHERE m >= 0.8 * (s.n + t.n - m)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.other = edges.x)
SELECT doc_id, MIN(other) AS class_id FROM reach GROUP BY doc_id
"""


def _spans_sql(kind: str, rank: int, pattern: str, test: str) -> str:
    """Matches with their places: the pieces between matches, and the matches before, add up to a match's start."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, (list_sum([len(x) for x in pieces[1:i]]) + COALESCE(list_sum([len(x) for x in matches[1:i - 1]]), 0))::BIGINT AS s, len(matches[i]) AS n
FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, $p${pattern}$p$) AS matches, string_split_regex(text, $p${pattern}$p$) AS pieces FROM documents WHERE text IS NOT NULL)) WHERE {test}"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

_SECRETS = f"""
WITH found AS ({_spans_sql("assign", 0, _ASSIGN, f"len(regexp_extract(matches[i], $p${_VALUE}$p$, 1)) >= 12")}
UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", "len(matches[i]) >= 18")} UNION ALL {_spans_sql("hex", 2, "[0-9a-f]{16,}", "TRUE")}
UNION ALL {" UNION ALL ".join(_spans_sql(r.kind, i, r.pattern, "TRUE") for i, r in enumerate(secrets.BASE + secrets.MORE) if i >= len(secrets.BASE))}),
listed AS (SELECT doc_id, COUNT(*) FILTER (WHERE rank = 0) AS a, COUNT(*) FILTER (WHERE rank = 1) AS b, COUNT(*) FILTER (WHERE rank = 2) AS c, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, COALESCE(a, 0)::BIGINT AS n_assign, COALESCE(b, 0)::BIGINT AS n_access, COALESCE(c, 0)::BIGINT AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM documents LEFT JOIN listed USING (doc_id)
"""


#: The level up to which all sources are filled, weight by weight, is the first, of those at which one more source is at twice its size, that this source can still take.
_TARGETS = r"""
WITH size AS (SELECT source, SUM(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM documents GROUP BY source),
own AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM size),
filled AS (SELECT *, 2 * n / w AS full_at, (SELECT 1.5 * SUM(n) FROM own) - SUM(2 * n) OVER o + 2 * n AS rest, SUM(w) OVER () - SUM(w) OVER o + w AS open FROM own WINDOW o AS (ORDER BY 2 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT arg_min(rest / open, full_at) FILTER (WHERE rest / open <= full_at) AS top FROM filled)
SELECT source, n AS source_size, ROUND(LEAST(2.0 * n, w * COALESCE(top, 1e300)), 3) AS target, TRUE AS near FROM own, level
"""

_COUNTS = r"""
WITH w AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING COUNT(*) > 1),
rep AS (SELECT doc_id, COUNT(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, COALESCE(list_sum([len(x) for x in ws]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, COALESCE(lines.n, 0)::BIGINT AS n_dup_lines, COALESCE(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force, round trips or held-out labels.

    That of the near duplicates compares all pairs that share a shingle; that of the secrets has all rules.
    """
    return {"op2_substring_dedup": _REPEATS, "op7_trigram_secrets": _SECRETS, "op9_bagminhash_dedup": _NEAR, "mix_targets": _TARGETS, "rule_counts": _COUNTS}
