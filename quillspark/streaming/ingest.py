"""Arriving files into a corpus, and windowed usage of its log, as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, at: str, schema, chunk: Callable[[DataFrame], DataFrame], chunks_to: str, manifests_to: str, checkpoint: str, key: str = "file_path", files_per_trigger: int = 1000) -> StreamingQuery:
    """Reads parquet files of documents as they arrive, chunks them, and publishes what is durable.

    Each micro-batch writes its chunks to a directory named by the batch, then its manifest rows to another; a batch
    that is run again overwrites both, so every file is there once. A document lies in one batch whole.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(at)

    def publish(batch: DataFrame, n: int) -> None:
        out = chunk(batch)
        out.write.mode("overwrite").parquet(f"{chunks_to}/batch={n}")
        done = batch.sparkSession.read.parquet(f"{chunks_to}/batch={n}")
        done.groupBy(key).agg(F.count("*").alias("chunk_count")).write.mode("overwrite").parquet(f"{manifests_to}/batch={n}")

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage(log: DataFrame, at: str = "logged_at", late: str = "5 days", window: str = "1 hour", keys: tuple[str, ...] = ("command_name",), once: str | None = "entry_id") -> DataFrame:
    """Runs and failures per window and command; repeated entries count once within the watermark.

    Works on a stream and on a table. A ``timestamp_ntz`` time is cast, as a watermark needs.
    """
    df = log.withColumn(at, F.col(at).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(at, late)
    if once:
        df = df.dropDuplicatesWithinWatermark([once]) if df.isStreaming else df.dropDuplicates([once])
    g = df.groupBy(F.window(at, window), *keys).agg(F.count("*").alias("runs"), F.count_if(F.col("error_text").isNotNull()).alias("failures"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "runs", "failures")
