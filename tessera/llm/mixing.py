"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import materialize

#: Sources beyond which the table of sources is joined by shuffle instead of broadcast (one row of a few hundred bytes each).
BROADCAST_SOURCES = 10_000
#: Documents at a time of which the last selection is made one by one.
LAST = 128
#: How near to its target a source has to come, as a share, before the search for documents that still fit ends.
NEAR = 0.002

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> np.ndarray:
    """Words per source: `share` of all words by weight; none above cap times its size, the excess shared anew by weight among the rest."""
    size, weight = np.asarray(sizes, dtype=float), np.asarray(weights, dtype=float)
    most, out = cap * size, np.zeros(size.size)
    full, left = np.zeros(size.size, dtype=bool), share * size.sum()
    while not full.all():
        give = np.where(full, 0, weight) / weight[~full].sum() * left
        over = ~full & (give > most)
        if not over.any():
            return np.where(full, out, give)
        out[over] = most[over]
        full |= over
        left = share * size.sum() - out.sum()
    return out


def _scale(rest: float, size: np.ndarray, words: np.ndarray, power: float) -> float:
    """c so that the sum of words * min(1, c * size ** power) is rest."""
    weight = np.power(np.maximum(size, 1e-9), power)
    order = np.argsort(-weight)
    weight, words = weight[order], words[order]
    certain = np.append(0, np.cumsum(words))
    tail = np.append(np.cumsum((words * weight)[::-1])[::-1], 0)
    for i in range(weight.size):
        c = (rest - certain[i]) / tail[i] if tail[i] > 0 else 0.0
        if c * weight[i] <= 1:
            return max(c, 0.0)
    return 1.0 / weight[-1] if weight.size else 0.0


def _plan(power: float):
    """A source's row: how many whole copies of all, the scale of inclusion odds, and the words yet to be selected."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = float(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        whole = int(min(target // total, 1 << 30)) if total else 0
        rest = target - whole * total
        c = _scale(rest, (pdf.words / pdf.n).to_numpy(float), pdf.words.to_numpy(float), power) if rest > 0 else 0.0
        return pd.DataFrame({"source": [pdf.source.iloc[0]], "source_size": [int(total)], "target": [target], "whole": [whole], "scale": [c], "rest": [rest], "n": [int(pdf.n.sum())]})

    return plan


def _last(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the documents next in order take each that still fits in the words left; of `n` rows that are the same, as many as fit."""
    pdf = pdf.sort_values(["rank", "key"])
    left, took, some = float(pdf.left.iloc[0]), [], []
    for size, key, n in zip(pdf["size"], pdf.key, pdf.n):
        fit = min(int(n), int(left // size))
        if fit == n:
            took.append(int(key))
        elif fit:
            some.append({"key": int(key), "quota": fit})
        left -= fit * size
    return pd.DataFrame({"source": [pdf.source.iloc[0]], "taken_keys": [took], "some": [some], "left": [left]})


def _in_order(df: DataFrame, label: str) -> DataFrame:
    """Written with `place`, each row's place from 0 in the order of its source (null last): ranges of the order are counted, then numbered."""
    own = df.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    own = materialize(own.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), label)
    parts = own.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return own.join(F.broadcast(before), "part").withColumn("place", F.col("at") + F.col("before")).drop("part", "at", "before")


def many_targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """targets() for a table of sources (source, source_size) that need not fit on the driver: each round adds up those at their cap, and shares out the rest."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    own = materialize(_in_order(totals, "ordered").withColumn("weight", w).withColumn("most", F.col("source_size") * float(cap)), "weights")
    level, everything = 0.0, None
    while True:
        over = F.col("most") < F.col("weight") * level
        full, open_weight, size = own.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.sum("source_size")).first()
        everything = everything or share * float(size or 0)
        now = (everything - full) / open_weight if open_weight else level
        if now <= level * (1 + 1e-12):
            break
        level = now
    return own.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Of the rows of each (source, key), written already with the part and place they were in, those whose number is below `quota`: `chosen`.

    Parts are counted and get their share of the quota in turn; only the rows of the one part in which it runs out are numbered one by one.
    """
    of = ["source", "key"]
    counts = rows.groupBy(*of, "part").agg(F.count("*").alias("n"), F.first("quota").alias("quota"))
    run = Window.partitionBy(*of).orderBy("part")
    own = counts.select(F.col("key").alias("of_key"), F.col("source").alias("of_source"), F.col("part").alias("of_part"), "n", (F.col("quota") - F.sum("n").over(run) + F.col("n")).alias("here"))
    joined = rows.join(own, (F.col("key") == F.col("of_key")) & (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source"))).drop("of_key", "of_part", "of_source")
    split = (F.col("here") > 0) & (F.col("here") < F.col("n"))
    number = F.row_number().over(Window.partitionBy(*of, "part").orderBy("at"))
    return joined.where(~split).withColumn("chosen", F.col("here") > 0).unionByName(joined.where(split).withColumn("chosen", number <= F.col("here")))


def mix(docs: DataFrame, size: Column | None = None, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), cap: float = 2.0, power: float = 0.25, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Choose how many copies of each document a mix has, so that each source comes near its target.

    Sources by code point (null last) weigh `weights`, repeating; targets(...) says how many words each gives.  Every document gets the
    whole copies that its source's target holds.  For what is left, inclusion odds go with size ** power, scaled so that the expected words
    are those left; documents whose inclusion is certain are taken, the others are ranked by Pareto order: random odds u / (1 - u) divided by
    inclusion odds p / (1 - p).  The first in that order are taken until the next would go beyond the target; of the hundred or so after it, those
    that still fit; behind them it goes on, among documents that are not larger than the words left, until those are a share NEAR of the target or no document
    fits.  u is a hash of seed, id and text, so reruns agree.

    Returns a row per input row: `row` (struct of the input's columns), `size`, `source_size`, `target`, `copies`.

    The sources' thresholds are found from per-source histograms of ranks, which combine on the map side; the mix itself is then a filter on each
    row, without a shuffle of texts.  Null or empty texts, and very long ones beyond the words left, have only whole copies; null is a source of its own.  Rows of the same
    source, id and text have one place in the order; where only some of them fit, that many are chosen (which ones, among rows that are the same, is left open).
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    text = docs[text_col] if text_col in docs.columns else F.lit(None).cast("string")
    key = F.xxhash64(F.lit(seed), docs[id_col], text)
    base = docs.select(row, docs[source_col].cast("string").alias("source"), (word_count(text) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"), key.alias("key"))
    small = materialize(base.select("source", "size", "key"), "sizes")

    totals = materialize(small.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n_sources = totals.count()
    if n_sources <= BROADCAST_SOURCES:
        held = sorted(((r.source, r.source_size) for r in totals.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
        want = targets([s for _, s in held], [weights[i % len(weights)] for i in range(len(held))], share, cap)
        wanted = spark.createDataFrame([(s, int(n), float(t)) for (s, n), t in zip(held, want)], "source string, source_size long, target double")
    else:
        wanted = materialize(many_targets(totals, weights, share, cap), "targets")

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "of")
        return left.join(F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    # inclusion scales, from counts of documents by size (sizes within 2 % count as one)
    step = F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double")) * 32)
    by_size = small.groupBy("source", step.alias("step")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    plans = materialize(with_source(by_size, wanted).groupBy("source").applyInPandas(_plan(power), "source string, source_size long, target double, whole int, scale double, rest double, n long"), "plans")

    inclusion = F.least(F.lit(1.0), F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(power)))
    u = (F.shiftrightunsigned("key", 11).cast("double") + 0.5) / float(1 << 53)
    # Pareto order in (0, 1): q / (1 + q); 0 is certain, 1 is never
    q = F.when(F.col("size") <= 0, 1.0).when(F.col("inclusion") >= 1, 0.0).when(F.col("inclusion") <= 0, 1.0).otherwise((u * (1 - F.col("inclusion"))) / (u * (1 - F.col("inclusion")) + (1 - u) * F.col("inclusion")))

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("inclusion", inclusion).withColumn("rank", q).drop("inclusion")

    # narrow down each source's threshold: first to one of up to 4096 steps of rank, then to about LAST documents, of which each that fits is taken;
    # where words are left over, go on behind them with what is not larger.  What did not fit never fits again, so rounds get ever smaller
    state = plans.where("rest > 0").select("source", F.col("rest").alias("left"), F.lit(0.0).alias("lo"), "n")
    spans, keys = [], []
    while True:
        level = ranked(with_source(small, plans.drop("rest", "n"))).join(F.broadcast(state.withColumnRenamed("source", "of")) if n_sources <= BROADCAST_SOURCES else state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).where("rank >= lo and rank < 1 and size <= left")
        level = level.select("source", "size", "key", "rank", "n", "lo", (1 - F.col("lo")).alias("width"), "left")
        begin = state.select("source", F.col("lo").alias("begin"), F.col("left").alias("most"))
        for _ in range(2):
            steps = F.greatest(F.lit(1.0), F.least(F.lit(4096.0), F.ceil(F.col("n") / LAST))).cast("double")
            level = level.withColumn("steps", steps).withColumn("bin", F.least(F.floor((F.col("rank") - F.col("lo")) / F.col("width") * F.col("steps")), F.col("steps") - 1).cast("int"))
            bins = level.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("in_bin"), F.first("left").alias("left"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("steps").alias("steps"))
            run = Window.partitionBy("source").orderBy("bin")
            bins = bins.withColumn("upto", F.sum("words").over(run))
            stop = bins.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("bin", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), (F.col("lo") + F.col("bin") * F.col("width") / F.col("steps")).alias("lo"), (F.col("width") / F.col("steps")).alias("width"), F.col("in_bin").alias("n")), "bin").alias("s"))
            stop = materialize(stop.select("source", F.col("s.bin").alias("at"), F.col("s.left").alias("left"), F.col("s.lo").alias("lo"), F.col("s.width").alias("width"), F.col("s.n").alias("n")), "thresholds")
            level = with_source(level.select("source", "size", "key", "rank", "bin"), stop).where("bin = at").select("source", "size", "key", "rank", "n", "lo", "width", "left")
        # rows that are the same are one row here, however many they are
        same = level.groupBy("source", "key", "size", "rank").agg(F.count("*").alias("n"), F.first("left").alias("left"))
        last = materialize(same.groupBy("source").applyInPandas(_last, "source string, taken_keys array<long>, some array<struct<key:long,quota:long>>, left double"), "last")
        keys.append(last.select("source", "taken_keys", "some"))
        # all up to the last step are taken; without a step beyond the target, all there are
        spans.append(with_source(begin, stop.select("source", F.col("lo").alias("end"))).select("source", F.struct("begin", F.coalesce("end", F.lit(1.0)).alias("end"), "most").alias("span")))
        behind = with_source(with_source(last.select("source", "left"), stop.select("source", (F.col("lo") + F.col("width")).alias("lo"))), plans.select("source", "target", "n"))
        state = materialize(behind.where((F.col("left") > NEAR * F.col("target")) & (F.col("left") >= 1) & (F.col("lo") < 1)).select("source", "left", "lo", "n"), "left")
        if state.isEmpty():
            break
    gather = lambda parts, *columns: reduce(DataFrame.unionByName, parts).groupBy("source").agg(*[F.collect_list(c).alias(f"{c}s") for c in columns])
    lists = gather(keys, "taken_keys", "some").select("source", F.flatten("taken_keyss").alias("taken_keys"), F.flatten("somes").alias("some"))
    final = with_source(with_source(plans, gather(spans, "span")), lists)
    final = materialize(final.select("source", "source_size", "target", "whole", "scale", "spans", "taken_keys", "some"), "mix")

    out = ranked(with_source(base, final))
    in_span = F.exists("spans", lambda x: (F.col("rank") >= x["begin"]) & (F.col("rank") < x["end"]) & (F.col("size") <= x["most"]))
    out = out.withColumn("chosen", (F.col("rank") < 1) & (F.coalesce(in_span, F.lit(False)) | F.coalesce(F.array_contains("taken_keys", F.col("key")), F.lit(False))))
    result = ["row", "size", "source_size", "target", (F.col("whole") + F.col("chosen").cast("int")).alias("copies")]
    if final.where(F.size("some") > 0).isEmpty():
        return out.select(*result)
    # rows that are the same and of which only some are taken
    out = out.withColumn("quota", F.when(~F.col("chosen") & (F.size("some") > 0), F.try_element_at(F.transform(F.filter("some", lambda x: x["key"] == F.col("key")), lambda x: x["quota"]), F.lit(1))))
    rows = materialize(out.where("quota is not null").select("row", "source", "key", "size", "source_size", "target", "whole", "quota", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "same")
    return out.where("quota is null").select(*result).unionByName(_numbered(rows).select(*result))
