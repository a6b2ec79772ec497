"""The corpus pipeline: documents judged, deduplicated, cleaned of secrets, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next; all but the last
return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bagminhash, isolation, mixing, packing, secrets
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.store import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the isolation forest reject go.

    Null, empty and wordless texts have fewer than ten words, so they go; very long texts are judged whole; rows that repeat, and scores that tie, are judged alike.
    """
    kept = isolation.judge(docs, table(spark, sf_dir, "labels"), keep_text=True).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays.

    Of rows that repeat id and text one stays; different texts with one id, or without one, are different documents; a text without words has no duplicates.
    """
    return bagminhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; n_chars is that of the new text.

    No row goes.  Null texts become empty ones; spans that overlap or touch the same text are one mask; very long texts are searched whole.
    """
    clean = secrets.redact(secrets.scan(docs))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return clean.select(*[(own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix has it: twice at most, and not at all where its source gives less than it has.

    Sources without a name are one; texts without words have only the whole copies of their source; of rows that repeat as many are taken as fit.
    """
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences of 2048.

    Null and empty texts are their end id alone; very long ones are cut into whole sequences and a rest; repeated rows are packed once each; of sequences that tie in cost the first
    is filled.
    """
    return packing.pack(docs, tokenizer_path(), capacity=2048, end=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pareto_mix", source_mix),
    ("cost_packing", sequence_packing),
]

#: Forests, signatures and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
