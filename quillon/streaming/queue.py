"""Streaming twins of the batch queue operators. The batch forms are the reference; these keep them current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery



def idempotent(events: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; later ones are dropped, and state with them."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def activity(events: DataFrame, time: str, kind: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by kind and tumbling window, final once the watermark has passed."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"))


def enqueue(events: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's new keys to a Parquet table: first writer wins, replays add nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            batch.dropDuplicates(keys).write.parquet(path)
            return
        fresh = batch.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


