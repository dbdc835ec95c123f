"""Streaming forms of the freshness gate, first-seen dedupe and entity resolution."""

from __future__ import annotations

from datetime import datetime
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import in_window
from ..operators.resolve import DEFAULT_THRESHOLD, NEW_ENTITY, resolve


def stream_fresh(stream: DataFrame, value: Column, reference_time: Column | datetime, window_hours: int = 24) -> DataFrame:
    """The gate on a stream; the reference may be a column such as the time of receipt."""
    return stream.filter(in_window(value, reference_time, window_hours))


def stream_first_seen(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """One row per key; state older than the delay is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to Parquet files, exactly once, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


class ResolvingSink:
    """``foreachBatch`` writer: resolves a batch against seeds and all entities found before.

    Registered entities live in a table with one folder per batch, read up to the
    current batch only.  A replayed batch therefore sees the same registry and
    overwrites its own folders.  One query writes one registry.
    """

    # Registered entities are placed behind all seeds.
    OFFSET = 1 << 61

    def __init__(
        self, seeds: DataFrame, name_col: str, order_col: str, path: str, threshold: float = DEFAULT_THRESHOLD
    ):
        self.seeds, self.name_col, self.order_col = seeds, name_col, order_col
        self.path, self.threshold = path.rstrip("/"), threshold

    def registry(self, batch_id: int) -> DataFrame:
        spark = self.seeds.sparkSession
        schema = "position BIGINT, canonical STRING, alias STRING, batch BIGINT"
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", f"{self.path}/registry").parquet(f"{self.path}/registry")
        return rows.filter(F.col("batch") < batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        known = self.registry(batch_id).drop("batch")
        seeds = self.seeds.select("position", "canonical", "alias").unionByName(known)
        out = f"{self.path}/resolved/batch={batch_id}"
        resolve(batch, self.name_col, self.order_col, seeds, self.threshold).write.mode("overwrite").parquet(out)
        new = batch.sparkSession.read.parquet(out).filter(F.col("method") == NEW_ENTITY)
        new.select(
            (F.col(self.order_col).cast("bigint") + self.OFFSET).alias("position"),
            F.col("canonical_name").alias("canonical"),
            F.col("canonical_name").alias("alias"),
        ).write.mode("overwrite").parquet(f"{self.path}/registry/batch={batch_id}")

    def resolved(self) -> DataFrame:
        return self.seeds.sparkSession.read.parquet(f"{self.path}/resolved")


def drain_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
