"""Quality rules, and an isolation forest on the rules' statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import FIT_ROWS, labelled, sample
from tessera.llm.statistics import COUNTS, RATES, rates, with_counts
from tessera.llm.store import materialize

#: Rows that each tree is grown on: isolation forests want few, so that anomalies do not hide one another.
TREE_ROWS = 128

#: The statistics the rules look at; of RATES.
RULES = ["mean_word", "symbol_share", "upper_word_share", "symbol_word_share", "pipe_share", "top_share", "distinct_share", "repeat_share", "dup_line_share", "punctuation_share", "short_share"]
_RULES = [RATES.index(r) for r in RULES]
VERDICT = ["base_failed", "anomaly", "kept"]


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # a row per tree, nodes as a heap; a node without children has an infinite split
    split: np.ndarray
    length: np.ndarray  # path length of rows that end in a node
    depth: int
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 ** -(mean path / expected path)."""
        total, rows = np.zeros(x.shape[0]), np.arange(x.shape[0])
        for t in range(self.feature.shape[0]):
            at = np.zeros(x.shape[0], np.int64)
            for _ in range(self.depth):
                inner = np.isfinite(self.split[t, at])
                step = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.split[t, at])
                at = np.where(inner, step, at)
            total += self.length[t, at]
        return np.exp2(-total / self.feature.shape[0] / max(float(_average_path(np.array(self.rows))), 1e-9))


def grow(x: np.ndarray, trees: int = 200, rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """Trees of random splits, each on a random part of x."""
    rng = np.random.default_rng(seed)
    rows = max(2, min(rows, x.shape[0]))
    depth = int(np.ceil(np.log2(rows))) + 2
    nodes = 2 ** (depth + 1) - 1
    feature, split, length = np.zeros((trees, nodes), np.int32), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    for t in range(trees if x.shape[0] else 0):
        todo = [(0, 0, rng.choice(x.shape[0], min(rows, x.shape[0]), replace=False))]
        while todo:
            node, level, own = todo.pop()
            length[t, node] = level + _average_path(np.array(own.size))
            lo, hi = x[own].min(0), x[own].max(0)
            able = np.flatnonzero(hi > lo)
            if own.size < 2 or level == depth or not able.size:
                continue
            j = int(rng.choice(able))
            cut = float(rng.uniform(lo[j], hi[j]))
            over = x[own, j] > cut
            if not over.any() or over.all():
                continue
            feature[t, node], split[t, node] = j, cut
            todo += [(2 * node + 1, level + 1, own[~over]), (2 * node + 2, level + 1, own[over])]
    return Forest(feature, split, length, depth, rows)


#: Ranks within this share of all rows count as the same where a threshold is taken.
RANK = 1e-6


def calibrate(scored: DataFrame, lost: float) -> float:
    """The least threshold above which at most a share `lost` of the good rows of scored (score, good) lies, to within RANK; infinite without good rows, or if labels do
    not bear out that what lies above is bad: most of it, and far more than elsewhere."""
    t, good, n = scored.agg(F.percentile_approx(F.when(F.col("good"), F.col("score")), 1 - lost, int(1 / RANK)), F.count_if("good"), F.count("*")).first()
    if t is None or good == n:
        return np.inf
    over, bad = scored.where(F.col("score") > t).agg(F.count("*"), F.count_if(~F.col("good"))).first()
    return float(t) if over and bad / over >= (1 + (n - good) / n) / 2 else np.inf


def _anomaly(forest: Forest):
    def run(batches):
        for batch in batches:
            x = rates({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x[:, _RULES])), pa.array(batch.column("label").to_numpy() == 1)], names=["score", "good"])

    return run


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _verdict(forest: Forest | None, threshold: float, counts: dict[str, np.ndarray]) -> list[pa.Array]:
    x = rates(counts)
    score = forest.score(x[:, _RULES]) if forest else np.zeros(len(x))
    failed = base_failed(counts["n_words"], counts["n_repeat_words"])
    return [pa.array(failed), pa.array(score), pa.array(~failed & (score <= threshold))]


def _judge(forest: Forest | None, threshold: float, kept: list[str]):
    def run(batches):
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in COUNTS}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*kept, *COUNTS)), *_verdict(forest, threshold, counts)], names=[*kept, *COUNTS, *VERDICT])

    return run


def judge(docs: DataFrame, labels: DataFrame | None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lost: float = 0.005, fit_rows: int = FIT_ROWS, keep_text: bool = False) -> DataFrame:
    """Quality rules for every document: `row` (struct of its columns other than the text), `text` if keep_text, the counts, `base_failed`, `anomaly` and `kept`.

    A document fails the base rules with fewer than 10 words or with more than a fifth of its words in repeated 5-word windows.  Of the others, an isolation forest finds
    those whose statistics random splits set apart early.  The forest is grown on at most fit_rows labelled rows; all labelled rows are scored by it in the cluster, and the
    threshold leaves at most a share `lost` of the good ones beyond it.  If labels do not bear out that what lies beyond is bad, or without labels, only the base rules reject.
    Whole texts are counted once, and the counts written (with keep_text, the texts beside them).

    Null or empty texts have no words and fail; very long ones are counted whole; null ids are judged and never learnt from; of several labels for one id the largest counts;
    a score that ties with the threshold is kept; repeated rows are judged alike; an empty table gives an empty one.
    """
    kept = ["row", "text"] if keep_text else ["row"]
    counts = materialize(with_counts(docs, text_col, [c for c in docs.columns if c != text_col], keep_text), "rules")
    forest, threshold = None, np.inf
    if labels is not None:
        own = labelled(counts.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))), labels, label_col, id_col)
        own = materialize(own, "labelled")
        x, _ = sample(own, fit_rows)
        if x.shape[0]:
            forest = grow(x[:, _RULES])
            threshold = calibrate(own.select(*COUNTS, "label").mapInArrow(_anomaly(forest), "score double, good boolean"), lost)
    row = counts.schema["row"].dataType.simpleString()
    return counts.mapInArrow(_judge(forest, threshold, kept), f"row {row}, {'text string, ' if keep_text else ''}" + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")
