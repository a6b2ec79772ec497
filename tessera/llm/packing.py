"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from tessera.llm.tokens import encoder
from tessera.llm.words import pieces, trim

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, tokens array<int>"

#: Tokens that are packed together: what a task holds at a time.  The padding of a group is under one sequence, so under 0.2 %.
GROUP_TOKENS = 1 << 20

#: Bytes of text that are encoded at a time: fewer than where ids alone are made, as whole groups are held beside them.
PIECE_BYTES = 1 << 19

#: Words that a worker's table keeps here, fewer than where ids alone are made: the table stays with the worker between tasks, and is copied whenever words are added.
KEPT = 1 << 18


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(document, start, length, sequence, offset) of each piece, and the number of sequences.

    A document's cost is linear * n + quadratic * n ** 2.  Documents longer than a sequence fill whole sequences first; their rests
    and all others, longest first (so dearest first), go to the sequence of least cost that has room.  As many sequences are open as the tokens need; a document
    that fits in none is cut over those with most room.
    """
    out, used = [], 0
    whole = lengths // capacity
    for i in np.flatnonzero(whole):
        for k in range(whole[i]):
            out.append((int(i), k * capacity, capacity, used, 0))
            used += 1
    rest = lengths - whole * capacity
    n = -(-int(rest.sum()) // capacity)
    room, cost = np.full(n, capacity, dtype=np.int64), np.zeros(n)

    def put(i: int, start: int, size: int, s: int) -> None:
        out.append((i, start, size, used + s, int(capacity - room[s])))
        room[s] -= size
        cost[s] += linear * size + quadratic * size * size

    for i in np.argsort(-rest, kind="stable"):
        size, start = int(rest[i]), int(whole[i]) * capacity
        if not size:
            break
        s = int(np.argmin(np.where(room >= size, cost, np.inf)))
        if room[s] >= size:
            put(int(i), start, size, s)
            continue
        while size:
            s = int(np.argmax(room))
            some = min(size, int(room[s]))
            put(int(i), start, some, s)
            start, size = start + some, size - some
    return out, used + n


def _pack(path: str, end: int, capacity: int, linear: float, quadratic: float, with_tokens: bool):
    def pack(batches):
        base, made = TaskContext.get().partitionId() << 40, 0
        ids, bodies, held = [], [], 0

        def flush():
            nonlocal ids, bodies, held, made
            n = np.array([len(x) // 4 for x in bodies], dtype=np.int64)
            placed, sequences = balance(n, capacity, linear, quadratic)
            doc, start, length, seq, at = (np.array(x, dtype=np.int64) for x in zip(*placed, strict=True))
            parts = [bodies[i][4 * a : 4 * (a + m)] for i, a, m, _, _ in placed]
            if with_tokens:
                tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.Array.from_buffers(pa.int32(), int(length.sum()), [None, pa.py_buffer(b"".join(parts))]))
            else:
                tokens = pa.nulls(len(parts), pa.list_(pa.int32()))
            cols = [pa.array([ids[i] for i in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(base + made + seq), pa.array(at), pa.array([zlib.crc32(x) for x in parts], pa.int64()), tokens]
            made += sequences
            ids, bodies, held = [], [], 0
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "tokens"])

        for batch in batches:
            for lo, texts in pieces(batch.column(1), PIECE_BYTES):
                names = batch.column(0).slice(lo, len(texts)).to_pylist()
                found, at = encoder(path, KEPT).with_end(texts, end)
                for name, a, b in zip(names, at[:-1].tolist(), at[1:].tolist()):
                    ids.append(name)
                    bodies.append(found[a:b].tobytes())
                    held += b - a
                    if held >= GROUP_TOKENS:
                        yield flush()
                        trim()
        if ids:
            yield flush()

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, with_tokens: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the ids of all texts, `end` after each, into sequences of at most `capacity` ids; a row per piece, with its ids if with_tokens.

    Each task packs what it reads, a group of about a million ids at a time, so nothing is shuffled and the ids never leave the task.  A sequence's number holds its
    task's, so numbers are unique; a task that is run again reads the same rows and makes the same sequences.

    Null or empty texts have the end id alone; null ids stay null; repeated rows are packed once each; an empty table has no pieces.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(_pack(tokenizer, end, capacity, linear, quadratic, with_tokens), PIECE_SCHEMA)
    return out if with_tokens else out.drop("tokens")


def padding(pieces_: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences, ids and padding in all: a sequence is padded to capacity unless its length is a power of two."""
    used = pieces_.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full = (F.col("n").bitwiseAND(F.col("n") - 1) == 0) | (F.col("n") == capacity)
    return used.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(full, 0).otherwise(capacity - F.col("n"))).alias("padding"))
