"""Schema inference over a stream: each micro-batch adds its observations to a table, from which the schema so far is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.infer.infer import build, summarize, told
from tessera.infer.observe import OBSERVATION, observe_json
from tessera.schema import Schema


class IncrementalInference:
    """Observations of a stream of JSON text, kept under `path`, one folder per micro-batch, so that a batch that is run again replaces its own."""

    def __init__(self, path: str, name: str = "inferred", locale: str = "in"):
        self.path, self.name, self.locale = path.rstrip("/"), name, locale

    def observe_batch(self, batch: DataFrame, batch_id: int) -> None:
        texts = batch.select((F.lit(batch_id).cast("long") * (1 << 40) + F.monotonically_increasing_id() % (1 << 40)).alias("number"), F.col(batch.columns[0]).cast("string").alias("value"))
        seen = texts.mapInPandas(observe_json, OBSERVATION).groupBy("path", "kind", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        seen.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.observe_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def schema(self, spark: SparkSession) -> Schema:
        """The schema of all that was seen so far."""
        seen = summarize(spark.read.schema(OBSERVATION).option("basePath", self.path).parquet(f"{self.path}/batch=*"), self.locale)
        return build(self.name, told(seen, self.name))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per window and keys; on a stream windows close when the watermark passes them.  Watermarks need a zone: times without one are read in the session's, and given back without one."""
    kind = events.schema[ts].dataType
    zoned = events.withColumn(ts, F.col(f"`{ts}`").cast("timestamp")).withWatermark(ts, lateness)
    counts = zoned.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast(kind).alias("window_start"), *keys, "n")
