"""Token files: ids as Parquet list columns in document order, for selective reads of tokens or of metadata alone."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.store import new_path, small_batches
from tessera.llm.tokens import PIECE_BYTES, encoder
from tessera.llm.words import pieces

FILE_SCHEMA = "doc_id long, part int, within long, n_tokens int, tokens array<int>"

#: Bytes of a row group and of a page, rows of a page.  Page indexes are always written; with rows in id order they let a reader skip to an id.
ROW_GROUP, PAGE, PAGE_ROWS = 64 << 20, 256 << 10, 512


def _encode(path: str, end: int):
    def encode(batches):
        part, within = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, texts in pieces(batch.column(1), PIECE_BYTES):
                ids, at = encoder(path).with_end(texts, end)
                n = np.diff(at)
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(np.full(n.size, part), pa.int32()), pa.array(within + at[:-1]), pa.array(n, pa.int32()), tokens], names=["doc_id", "part", "within", "n_tokens", "tokens"])
                within += int(at[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write its ids, with `end` after them, in ascending id order to Parquet files under path.

    encoding: "dictionary" (ids as indexes into each row group's dictionary, bit-packed) or "delta" (DELTA_BINARY_PACKED, for vocabularies
    beyond a dictionary page).  doc_id, part and counts are delta encoded; a reader of those alone touches no token page.

    Null or empty texts have the end id alone; null ids come first; rows with equal ids are ordered by a hash of the text and may go to several files; very long texts are one row each; an empty table writes a file without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # rows with one id, and copies of one text among them, can go to several files too
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "tie", "at").sortWithinPartitions("doc_id", "tie", "at")
    ids = ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer, end), FILE_SCHEMA)
    out = ids.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS)
    out = out.option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
    with small_batches(docs.sparkSession):
        out.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, of ids first to last if given; pages of other ids are skipped, as are columns that are not used."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that have a document's part and place within, with `start`, the ids of all documents before: a running sum over the files' parts, of which there are few, plus the place within."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").withColumn("start", F.col("before") + F.col("within")).drop("before")


def _crc32(batches):
    for batch in batches:
        lists = batch.column(1)
        off = lists.offsets.to_numpy()
        body = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B")
        crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(off, off[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), *(batch.column(i) for i in range(2, batch.num_columns))], names=["doc_id", "ids_crc32", *batch.schema.names[2:]])


def checksums(files: DataFrame) -> DataFrame:
    """doc_id, part, within, n_tokens and the crc32 of each document's ids as little-endian 32-bit integers, from what the files hold."""
    return files.select("doc_id", "tokens", "part", "within", "n_tokens").mapInArrow(_crc32, "doc_id long, ids_crc32 long, part int, within long, n_tokens int")


def token_table(docs: DataFrame, tokenizer: str, end: int = 0, **how) -> DataFrame:
    """Write the token files in the shared folder, read them back, and return doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end, **how)
    files = read_tokens(docs.sparkSession, path)
    return with_start(checksums(files), files).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
