"""Periodic feeds as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from busweave.operators.shaping import last_per_key


def read_feed(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def upsert_stream(stream: DataFrame, key: str, ts: str, target: str, checkpoint: str, tie: str | None = None) -> StreamingQuery:
    """Keep the newest version of every record.

    Each batch is first cut to its newest row per key and appended as one version under its batch
    number; a repeated batch overwrites its own folder, so a retry adds nothing. ``read_upserted``
    resolves versions at read time, which costs one aggregate and never rewrites old data.
    """
    order = [ts, tie] if tie else [ts]

    def write(batch: DataFrame, batch_id: int) -> None:
        last_per_key(batch, [key], order).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_upserted(spark: SparkSession, key: str, ts: str, target: str, tie: str | None = None) -> DataFrame:
    rows = spark.read.parquet(target)
    return last_per_key(rows, [key], [ts, *([tie] if tie else []), "batch"]).drop("batch")


def compact_upserted(spark: SparkSession, key: str, ts: str, target: str, compacted: str, tie: str | None = None) -> None:
    """Write the current versions to a new folder."""
    read_upserted(spark, key, ts, target, tie).write.parquet(compacted)


def distinct_stream(stream: DataFrame, key: str, ts: str, delay: str, target: str, checkpoint: str) -> StreamingQuery:
    """First version of every record within a watermark; the state is dropped after ``delay``."""
    return (
        stream.withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark([key])
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def append_by_day(stream: DataFrame, ts: str, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append vehicle positions to day partitions; ``every`` sets a polling interval, else all input
    that is there is taken once."""
    writer = (
        stream.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .outputMode("append")
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
