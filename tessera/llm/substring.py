"""Removal of long passages that an earlier document has: one doubling, from repeated half-length anchors to windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import materialize
from tessera.llm.words import U64, Runs, pieces, signed, split


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the index of its smallest, the first among equal ones, by doubling."""
    at, span = np.arange(values.size), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at, span = np.where(values[b] < values[a], b, a), span + step
    return at


def runs(one: Runs, two: Runs, counts: np.ndarray, length: int):
    """Windows of `length` words, gathered into runs of neighbouring windows that have the same anchor.

    The anchor of a window is its half-length gram of the least hash, so it depends on the window's words alone: equal windows,
    wherever they are, have equal anchors at the same place.  `one` and `two` are runs of the words' hashes of two seeds.  Returns (text, first window,
    last window, anchor's hash by the first, hash of the words of the whole run by the second); window numbers count all words of all texts.
    """
    half, n = (length + 1) // 2, one.levels[0].size
    none = np.zeros(0, np.int64)
    nothing = none, none, none, none.view(U64), none.view(U64)
    if n < length:
        return nothing
    gram = one.all(half)
    anchor = leftmost_minimum(gram, length - half + 1)
    text = np.repeat(np.arange(counts.size), counts)
    window = np.arange(n - length + 1)
    valid = text[window] == text[window + length - 1]
    window, anchor = window[valid], anchor[valid]
    if not window.size:
        return nothing
    new = np.ones(window.size, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[window[1:]] != text[window[:-1]])
    at = np.flatnonzero(new)
    lo = window[at]
    hi = window[np.append(at[1:], window.size) - 1]
    return text[lo], lo, hi, gram[anchor[at]], two.some(lo, hi - lo + length)


# --- the distributed part -------------------------------------------------------------------------------------------------

#: Null ids come after every id.
LAST_ID = (1 << 63) - 1

#: Of the second hash of a word.
SEED = 0x5EED

#: r1 and r2 name a row by its id and text, in 128 bits; did is its id.
ROW = ["did", "r1", "r2"]
RUN_SCHEMA = "gram long, seg long, did long, r1 long, r2 long, s int, n int"
WINDOW_SCHEMA = "w1 long, w2 long, did long, r1 long, r2 long, s int"


def _rows(batch: pa.RecordBatch, lo: int, text: np.ndarray) -> list[pa.Array]:
    """ROW of the texts with these numbers, counted from the batch's row `lo`."""
    own = pa.array(lo + text)
    return [batch.column(c).take(own) for c in ROW]


def _emit_runs(length: int):
    def emit(batches):
        for batch in batches:
            for lo, part in pieces(batch.column("text")):
                w = split(part)
                text, a, b, gram, seg = runs(Runs(w.hashes()), Runs(w.hashes(SEED)), w.counts(), length)
                if text.size:
                    cols = [pa.array(signed(gram)), pa.array(signed(seg)), *_rows(batch, lo, text), pa.array((a - w.first[text]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["gram", "seg", *ROW, "s", "n"])

    return emit


def _settle(length: int):
    """Documents with their runs: kept text and spans where all runs are settled; else the text, for another look at its open windows."""

    def settle(batches):
        for batch in batches:
            out = {"keep": [], "spans": [], "n_words": [], "n_removed": [], "text": []}
            spans, texts = batch.column("found").to_pylist(), batch.column("text")
            more = batch.column("more").to_pylist() if "more" in batch.schema.names else None
            for lo, part in pieces(texts):
                w = split(part)
                for i in range(len(part)):
                    found = spans[lo + i] or []
                    windows = [(f["s"], f["s"] + f["n"]) for f in found if not f["open"]]
                    is_open = any(f["open"] for f in found)
                    if more is not None:
                        windows += [(s, s + 1) for s in more[lo + i] or []]
                        is_open = False
                    n = int(w.first[i + 1] - w.first[i])
                    out["n_words"].append(n)
                    out["text"].append(part[i].as_py() if is_open else None)
                    if is_open:
                        out["keep"].append(None), out["spans"].append(None), out["n_removed"].append(None)
                        continue
                    gone = cover([(a, b - 1 + length) for a, b in windows], n)
                    words = w.strings(i)
                    if gone:
                        kept, at = [], 0
                        for a, b in gone:
                            kept += words[at:a]
                            at = b
                        words = kept + words[at:]
                    out["keep"].append(b" ".join(words).decode())
                    out["spans"].append([{"start": a, "end": b} for a, b in gone])
                    out["n_removed"].append(sum(b - a for a, b in gone))
            cols = {name: batch.column(name) for name in ("row", *ROW, "found")}
            cols |= {"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_text": pa.array(out["keep"], pa.string()), "removed": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "text": pa.array(out["text"], pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return settle


def cover(windows: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Half-open spans merged where they meet, in order."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _emit_windows(length: int):
    def emit(batches):
        for batch in batches:
            found = batch.column("found").to_pylist()
            for lo, part in pieces(batch.column("text")):
                w = split(part)
                one, two = Runs(w.hashes()).all(length), Runs(w.hashes(SEED)).all(length)
                starts, texts = [], []
                for i in range(len(part)):
                    own = np.unique(np.concatenate([np.arange(f["s"], f["s"] + f["n"]) for f in found[lo + i] if f["open"]]))
                    starts.append(own)
                    texts.append(np.full(own.size, i))
                s, t = np.concatenate(starts), np.concatenate(texts)
                at = s + w.first[t]
                yield pa.RecordBatch.from_arrays([pa.array(signed(one[at])), pa.array(signed(two[at])), *_rows(batch, lo, t), pa.array(s.astype(np.int32))], names=["w1", "w2", *ROW, "s"])

    return emit


def remove_repeated(docs: DataFrame, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of `words` consecutive words that also starts in a document with a smaller id.

    Returns a row per input row: `row` (struct of the input's columns other than the text, so none can clash), `n_words`, `n_removed`, `removed` (spans of
    word numbers, end exclusive) and `kept_text` (the kept words joined by one space).

    Level-wise doubling.  At half the length only grams that anchor a window (about one word in thirteen: the gram of least hash in each
    window) need be kept, because equal windows have equal anchors.  Anchors found in one document alone end there.  The survivors are
    extended to the full length a run of neighbouring windows at a time: a run that an earlier document has word for word is settled.  What
    is left, the first copies of runs whose anchor has differing neighbourhoods, is extended window by window, with 128-bit hashes.
    No level is capped, and every aggregate combines on the map side, so a passage that a third of all documents share is one row a task.

    Null texts have no words; texts shorter than a window lose nothing; null ids come after all ids; rows with equal ids do not remove
    from one another; repeated rows give repeated results; an empty table gives an empty one.
    """
    row = F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")
    did, text = F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)), docs[text_col].cast("string")
    src = docs.select(did.alias("did"), F.xxhash64(did, text).alias("r1"), F.xxhash64(F.lit(SEED), text, did).alias("r2"), text.alias("text"), row)
    found = src.select(*ROW, "text").mapInArrow(_emit_runs(words), RUN_SCHEMA)
    # aggregates are written before they are joined, so that a hot key's rows on the other side can be split
    grams = materialize(found.groupBy("gram").agg(F.min("did").alias("d0"), F.max("did").alias("d1"), F.min("seg").alias("x"), F.max("seg").alias("y")).where("d0 < d1").drop("d1"), "repeated")
    common = materialize(found.join(grams, "gram"), "grams")
    pure, mixed = common.where("x = y"), common.where("x < y").drop("d0")
    first = materialize(mixed.groupBy("gram", "seg").agg(F.min("did").alias("d0")), "first")
    both = pure.where("did > d0").select(*ROW, "s", "n", F.lit(False).alias("open")).unionByName(mixed.join(first, ["gram", "seg"]).select(*ROW, "s", "n", (F.col("did") == F.col("d0")).alias("open")))
    spans = both.groupBy(*ROW).agg(F.collect_list(F.struct("s", "n", "open")).alias("found"))
    schema = src.select("row", *ROW).schema.add("found", spans.schema["found"].dataType)
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("removed", "array<struct<start:int,end:int>>"), ("text", "string")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    # the text is shuffled once; documents that are settled leave it behind
    joined = src.join(spans, ROW, "left").select("row", *ROW, "found", "text")
    settled = materialize(joined.mapInArrow(_settle(words), schema), "settled")
    is_open = F.col("text").isNotNull()
    windows = settled.where(is_open).select(*ROW, "found", "text").mapInArrow(_emit_windows(words), WINDOW_SCHEMA)
    windows = materialize(windows, "windows")
    least = materialize(windows.groupBy("w1", "w2").agg(F.min("did").alias("d0"), F.max("did").alias("d1")).where("d0 < d1").drop("d1"), "least")
    more = windows.join(least, ["w1", "w2"]).where("did > d0").groupBy(*ROW).agg(F.collect_list("s").alias("more"))
    again = settled.where(is_open).join(more, ROW, "left").select("row", *ROW, "found", "text", "more").mapInArrow(_settle(words), schema)
    out = ["row", "n_words", "n_removed", "removed", "kept_text"]
    return settled.where(~is_open).select(*out).unionByName(again.select(*out))
