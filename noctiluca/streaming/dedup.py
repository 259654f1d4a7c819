"""Deduplication across batches, as a stream with state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctiluca.functions import text
from noctiluca.operators.records import with_prefix
from noctiluca.session import shared_folder


def keyed_stream(stream: DataFrame, prefix: str | None = "astro-ph.", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The stream's records without those whose key was seen before. With an event time and a delay, keys are forgotten
    once the watermark has passed them, which bounds the state; otherwise all keys are kept."""
    kept = with_prefix(stream, prefix) if prefix else stream
    keyed = kept.withColumn("dedup_key", text.dedup_key(F.col("url"), F.col("title"), F.col("published")))
    if event_time and delay:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["dedup_key"])
    return keyed.dropDuplicates(["dedup_key"])


def run_available(stream: DataFrame, out: str, checkpoint: str | None = None) -> None:
    """Process everything there is now, append it to a folder, and stop. Started again with the same checkpoint folder it
    goes on with what has come since; without one its state stands in a new folder of those all executors share."""
    checkpoint = checkpoint or shared_folder(stream.sparkSession, "stream-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
