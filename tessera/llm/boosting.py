"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays for numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.samples import first_bins
from tessera.llm.statistics import COUNTS, rates, with_counts
from tessera.llm.store import materialize

#: Labelled rows that a model is fitted on at most, those of least hash; fitting is the only thing that is bounded.
FIT_ROWS = 20_000
BINS = 64


@dataclass
class Trees:
    """All trees' nodes in arrays: a row per tree.  A leaf leads to itself, so every row of X takes `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape[0], self.start)
        rows = np.arange(x.shape[0])
        for t in range(self.feature.shape[0]):
            at = np.zeros(x.shape[0], np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[t, at]] <= self.threshold[t, at], self.left[t, at], self.right[t, at])
            out += self.value[t, at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, least: int = 20, l2: float = 1.0, bins: int = BINS) -> Trees:
    """Logistic loss; level by level, each node split where the gain over histograms of gradients is largest."""
    n, k = x.shape
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    feature, threshold, value = np.zeros(shape, np.int32), np.full(shape, np.inf), np.zeros(shape)
    left = np.tile(np.arange(nodes, dtype=np.int32), (trees, 1))
    right = left.copy()
    if not n or y.min() == y.max():
        p = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
        return Trees(feature, threshold, left, right, value, depth, float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])  # bin b holds x <= edges[b]
    p = y.mean()
    start = float(np.log(p / (1 - p)))
    raw = np.full(n, start)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            live = at >= base  # rows whose node was split so far
            own, g, h = at[live] - base, grad[live], hess[live]
            gain, where = np.full(width, 1e-3), np.full((width, 2), -1)
            for j in range(k):
                m = edges[j].size + 1
                if m < 2:
                    continue
                key = own * m + binned[live, j]
                hg, hh, hn = (np.bincount(key, weights=v, minlength=width * m).reshape(width, m).cumsum(1) for v in (g, h, np.ones(own.size)))
                tg, th, tn = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                score = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
                score[(hn < least) | (tn - hn < least)] = 0
                best = score[:, :-1].argmax(1)
                top = score[np.arange(width), best]
                better = top > gain
                gain[better], where[better] = top[better], np.column_stack([np.full(width, j), best])[better]
            for i in np.flatnonzero(where[:, 0] >= 0):
                node, (j, b) = base + i, where[i]
                feature[t, node], threshold[t, node] = j, edges[j][b]
                left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
            go = at >= base
            split = go & (left[t, at] != at)
            j = feature[t, at[split]]
            at[split] = np.where(x[np.flatnonzero(split), j] <= threshold[t, at[split]], 2 * at[split] + 1, 2 * at[split] + 2)
        sums_g, sums_h = np.bincount(at, weights=grad, minlength=nodes), np.bincount(at, weights=hess, minlength=nodes)
        value[t] = rate * sums_g / (sums_h + l2)
        raw += value[t, at]
    return Trees(feature, threshold, left, right, value, depth, start)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(counts: DataFrame, labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """COUNTS, `label` and the id's hash and name (`order`, `label_of`) of all labelled documents that aren't held out."""
    ids = labels.select(F.col(id_col).alias("label_of"), F.col(label_col).cast("double").alias("label")).where("label is not null and label_of is not null").groupBy("label_of").agg(F.max("label").alias("label"))
    own = counts.where(~held_out(F.col(f"row.{id_col}")))
    return own.join(ids, F.col(f"row.{id_col}") == F.col("label_of")).select(*COUNTS, "label", F.xxhash64("label_of").alias("order"), "label_of")


def sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """RATES and labels of at most `most` of labelled(...), which is read several times: those of least hash of their id.

    Counts of bins of that hash tell where they end, so hardly more rows than that leave their tasks, however many there are.  Where one id has more rows than are asked for, those of
    least hash of their counts are taken; rows that are the same travel as one.
    """
    rows = rows.withColumn("tie", F.xxhash64(*COUNTS))
    kept, last, n = first_bins(rows, "order", most)
    if n > most:
        few, edge, _ = first_bins(last, "tie", most)
        last = few.unionByName(edge)
    by = ["order", "label_of", "tie", "label", *COUNTS]
    pdf = kept.unionByName(last).groupBy(*by).agg(F.count("*").alias("copies")).orderBy(*by).limit(most).toPandas()
    pdf = pdf.loc[np.repeat(np.arange(len(pdf)), np.minimum(pdf.copies, most))].iloc[:most]
    return rates({c: pdf[c].to_numpy() for c in COUNTS}), pdf["label"].to_numpy(float)


def _score(model: Trees):
    def score(batches):
        for batch in batches:
            x = rates({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(x)), pa.array(np.asarray(batch.column("n_words")))], names=["row", "score", "n_words"])

    return score


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every document: `row` (struct of its columns other than the text), `score` from 0 to 1 and `n_words`.

    The statistics are counted once over whole texts and written; at most fit_rows labelled rows are fitted on the driver; the flattened trees
    (about 100 KB whatever the input) go with the tasks that score.  Labels, ids, languages and sources are no inputs.

    Null or empty texts have zeros as statistics and are scored as any other, very long ones by the whole text; ties score alike, as do repeated rows; without usable labels every score is a half; rows with null ids are scored
    and never learnt from; of several labels for one id the largest counts; an empty table gives an empty one.
    """
    counts = materialize(with_counts(docs, text_col, [c for c in docs.columns if c != text_col]), "statistics")
    x, y = sample(materialize(labelled(counts, labels, label_col, id_col), "labelled"), fit_rows)
    row = counts.schema["row"].dataType.simpleString()
    return counts.mapInArrow(_score(fit(x, y)), f"row {row}, score double, n_words long")
