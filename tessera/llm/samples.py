"""Bounded samples by hash, of which hardly more rows than asked for leave their tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_bins(rows: DataFrame, column: str, most: int) -> tuple[DataFrame, DataFrame, int]:
    """Of 2 ** 16 bins of a hash the rows of those before the one in which the `most`-th row lies, the rows of that one, and how many it has."""
    at = F.shiftright(column, 48)
    bins = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).toPandas().sort_values("bin")
    last = int(np.searchsorted(bins.n.cumsum().to_numpy(), most))
    if last >= len(bins):
        return rows, rows.where(F.lit(False)), 0
    edge = int(bins.bin.iloc[last])
    return rows.where(at < edge), rows.where(at == edge), int(bins.n.iloc[last])
