"""Statistics of whole documents as numpy columns, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from tessera.llm.words import U64, Words, grams, mix, pieces, span_hashes, split

#: The characters that the rules count as symbols.
SYMBOLS = "#*$%&|<>"

#: What is counted in each text.
COUNTS = ["n_words", "word_chars", "n_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_punctuation", "n_ends", "n_pipes", "n_short_words", "n_long_words", "n_capitalised", "n_upper_words", "n_symbol_words", "top_word", "n_word_lines", "word_square"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of flags are set in each text."""
    total = np.zeros(flags.size + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _line_spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the lines, which end at each newline and at the end of a text."""
    at = np.flatnonzero(w.data == 0x0A)
    text = np.searchsorted(w.offsets, at, side="right") - 1
    n = w.offsets.size - 1
    texts = np.concatenate([np.arange(n), text])
    starts = np.concatenate([w.offsets[:-1], at + 1])
    order = np.lexsort((starts, texts))
    texts, starts = texts[order], starts[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(texts[1:] != texts[:-1], True)
    ends[last] = w.offsets[texts[last] + 1]
    return texts, starts, ends


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(keys.size, bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; null counts as empty."""
    if not len(texts):
        return {c: np.zeros(0, np.int64) for c in COUNTS}
    w = split(texts)
    n_docs, n = len(texts), w.counts()
    doc, h = w.texts(), w.hashes()
    out = {"n_words": n}
    lead = (w.data & 0xC0) != 0x80  # the first byte of each character
    chars = np.zeros(w.data.size + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    out["n_chars"] = chars[w.offsets[1:]] - chars[w.offsets[:-1]]
    length = chars[w.ends] - chars[w.starts]
    per = lambda values: np.bincount(doc, weights=values, minlength=n_docs).astype(np.int64)
    out["word_chars"], out["word_square"] = per(length), per(length * length)
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punctuation", _PUNCTUATION)):
        out[name] = _sums(kind[w.data], w.offsets)
    out["n_pipes"] = _sums(w.data == ord("|"), w.offsets)
    first, last = (w.data[w.starts], w.data[w.ends - 1]) if h.size else (np.zeros(0, np.uint8),) * 2
    out["n_ends"], out["n_capitalised"] = per(_END[last]), per(_UPPER[first])
    out["n_symbol_words"] = per(_SYMBOL[last])
    out["n_short_words"], out["n_long_words"] = per(length <= 2), per(length >= 12)
    upper = np.zeros(w.data.size + 1, np.int64)
    np.cumsum(_UPPER[w.data], out=upper[1:])
    out["n_upper_words"] = per((upper[w.ends] - upper[w.starts]) * 2 > length)
    # words that recur: distinct ones and the commonest
    salt = mix(np.arange(n_docs, dtype=U64) + U64(1))
    keys = np.sort(h ^ salt[doc])
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    times = np.diff(np.append(new, keys.size))
    order = np.argsort(h ^ salt[doc], kind="stable") if keys.size else np.zeros(0, np.int64)
    own = doc[order[new]] if keys.size else np.zeros(0, np.int64)
    out["n_distinct_words"] = np.bincount(own, minlength=n_docs)
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, own, times)
    out["top_word"] = top
    # words in 5-word windows found twice or more in the text
    covered = np.zeros(h.size + 1, np.int64)
    if h.size >= 5:
        at = np.flatnonzero(doc[:-4] == doc[4:])
        twice = at[_repeated(grams(h, 5)[at] ^ salt[doc[at]])]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    out["n_repeat_words"] = per(np.cumsum(covered)[:-1] > 0)
    # lines that have a word and are equal to an earlier one
    text, lo, hi = _line_spans(w)
    out["n_lines"] = np.bincount(text, minlength=n_docs)
    worded = np.searchsorted(w.starts, hi) > np.searchsorted(w.starts, lo)
    text, lo, hi = text[worded], lo[worded], hi[worded]
    out["n_word_lines"] = np.bincount(text, minlength=n_docs)
    if lo.size:
        line = span_hashes(w.data, lo, hi) ^ salt[text]
        kinds, where = np.unique(line, return_index=True)
        out["n_dup_lines"] = out["n_word_lines"] - np.bincount(text[where], minlength=n_docs)
    else:
        out["n_dup_lines"] = np.zeros(n_docs, np.int64)
    return out


def _count(keep_text: bool):
    def run(batches):
        for batch in batches:
            for lo, part in pieces(batch.column(1)):
                got = count(part)
                kept = [batch.column(0).slice(lo, len(part)), *([part] if keep_text else [])]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["row", *(["text"] if keep_text else []), *COUNTS])

    return run


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """`row` (struct of the input's columns, or of those in keep), the text if keep_text, and COUNTS, for each document; whole texts, one pass, no shuffle."""
    row = F.struct(*[docs[c] for c in (keep or docs.columns)]).alias("row")
    src = docs.select(row, docs[text_col].cast("string").alias("text"))
    schema = src.schema["row"].dataType
    return src.mapInArrow(_count(keep_text), f"row {schema.simpleString()}, {'text string, ' if keep_text else ''}" + ", ".join(f"{c} long" for c in COUNTS))


#: Shares and means made of the counts, free of a text's length but for the first.
RATES = ["log_words", "mean_word", "word_spread", "symbol_share", "upper_share", "digit_share", "punctuation_share", "end_share", "pipe_share", "short_share", "long_share", "capital_share", "upper_word_share", "symbol_word_share", "top_share", "distinct_share", "repeat_share", "dup_line_share", "words_per_line", "space_share"]


def rates(c: dict[str, np.ndarray]) -> np.ndarray:
    """A row of RATES per document; empty texts have zeros."""
    x = {k: np.asarray(v, dtype=float) for k, v in c.items()}
    n, chars = np.maximum(x["n_words"], 1), np.maximum(x["n_chars"], 1)
    mean = x["word_chars"] / n
    cols = [
        np.log1p(x["n_words"]), mean, np.sqrt(np.maximum(x["word_square"] / n - mean**2, 0)), x["n_symbols"] / chars, x["n_upper"] / chars, x["n_digits"] / chars, x["n_punctuation"] / chars,
        x["n_ends"] / n, x["n_pipes"] / n, x["n_short_words"] / n, x["n_long_words"] / n, x["n_capitalised"] / n, x["n_upper_words"] / n, x["n_symbol_words"] / n, x["top_word"] / n,
        x["n_distinct_words"] / n, x["n_repeat_words"] / n, x["n_dup_lines"] / np.maximum(x["n_word_lines"], 1), x["n_words"] / np.maximum(x["n_word_lines"], 1), 1 - x["word_chars"] / chars,
    ]
    return np.nan_to_num(np.column_stack(cols))
