"""Structured Streaming faces of ingestion and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomdex.operators import store


def upserts(spark: SparkSession, folder: str, schema: str, target: store.Table, key: str, checkpoint: str, order: str) -> StreamingQuery:
    """Rows that arrive as Parquet files are upserted into a table, the last by ``order`` for each key. A micro-batch that is run again after a
    failure gives the same table."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            target.upsert(store.latest_rows(batch, key, [order]), key)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, folder: str, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Questions (query_id, text) that arrive as JSON files are answered batch by batch against the tables that ``answer`` holds; the
    answers of batch n are in ``out/batch=n``."""

    def apply(batch: DataFrame, n: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream = spark.readStream.schema("query_id string, text string").json(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by tumbling window, for streams and tables alike; a stream drops what is later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", window)
    return rows.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
