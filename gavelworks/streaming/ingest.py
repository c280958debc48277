"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import upsert
from ..sources.keyed import BUCKETS, KeyedTable


def new_rulings(spark: SparkSession, path: str, schema: str, key: str = "id", delay: str = "1 day", time: str = "fetched_at") -> DataFrame:
    """Stream of ruling pages arriving as Parquet, each id once within the watermark."""
    s = spark.readStream.schema(schema).parquet(path)
    return s.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def upsert_sink(table: str, key: str = "id", time: str = "fetched_at"):
    """foreachBatch function that merges a batch into a table of Parquet versions; a replayed batch changes nothing.

    Of a key's rows in a batch the one of the last ``time`` stays (of equal ones the greatest by its JSON).  Every epoch
    writes the whole table; ``keyed_sink`` writes what it touches."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*batch.columns)
        latest = batch.groupBy(key).agg(F.max_by(row, F.struct(*[c for c in [time] if c in batch.columns], F.to_json(row))).alias("_r")).select("_r.*")
        old = f"{table}/v={epoch - 1}"
        base = spark.read.parquet(old) if epoch else latest.limit(0)
        upsert(base, latest, key).write.mode("overwrite").parquet(f"{table}/v={epoch}")

    return sink


def keyed_sink(table: str, key: str = "id", time: str | None = "fetched_at", buckets: int = BUCKETS):
    """foreachBatch function that merges a batch into a ``KeyedTable``: only touched buckets are rewritten, the last row
    by ``time`` stays, and a replayed epoch changes nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        KeyedTable(batch.sparkSession, table, key, time, buckets).upsert(batch, epoch)

    return sink


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and values of each type in tumbling windows; on a stream, windows close once the watermark passes them."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
