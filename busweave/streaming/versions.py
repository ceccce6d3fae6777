"""Upsert by id into the collection of a day, with the newest versions in keyed state.

A record's newest version of the day is held in the state of a streaming aggregate. When the watermark passes the end
of the day the version goes to the settled rows, one per id and day for good, and the state is dropped. So state and
the open rows are those of days that are not over, and a read meets one row per record, however often it came. Nothing
is called per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from busweave.operators.shaping import last_per_key

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _arrival() -> Column:
    """Number of a row within its batch, by partition and place in it; of equal versions the first to arrive stays."""

    @F.pandas_udf("long")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pd.Series(np.arange(first, first + len(batch)), dtype="int64")
            first += len(batch)

    return number.asNondeterministic()("__at")


def _delay_ms(spark: SparkSession, delay: str) -> int:
    """Milliseconds of an interval, a month as 31 days, as for a watermark."""
    units = {"YEAR": 12 * 31 * DAY_MS, "MONTH": 31 * DAY_MS, "DAY": DAY_MS, "HOUR": 3_600_000, "MINUTE": 60_000, "SECOND": 1000}
    parts = [F.expr(f"extract({unit} FROM delay) * {ms}").cast("long") for unit, ms in units.items()]
    return spark.range(1).select(F.lit(delay).cast("interval").alias("delay")).select(sum(parts, F.lit(0))).first()[0]


def _slot(target: str, batch_id: int) -> str:
    return f"{target}/open/slot={batch_id % 2}"


def _newest_batch(spark: SparkSession, path: str) -> int | None:
    return spark.read.parquet(path).where("__mark").agg(F.max("__batch")).first()[0] if _exists(spark, path) else None


def _open_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the newest snapshot below ``path``; each snapshot carries its number in a row of its own."""
    newest = _newest_batch(spark, path)
    if newest is None:
        return None
    both = spark.read.parquet(path)
    return both.where((F.col("__batch") == newest) & ~F.col("__mark")).drop("__batch", "__mark", "slot")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert_by_day(
    stream: DataFrame, key: str, ts: str, target: str, checkpoint: str, delay: str = "1 hour", tie: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Keep the newest version of every record of every day (of ``ts``, in UTC) in ``target``.

    Versions are ordered by ``ts``, then by ``tie``, a number or text (nulls first); of versions that are equal in both the first to
    arrive stays. A row more than ``delay`` behind the newest ``ts`` of earlier batches is late and may be left out;
    one of a day already settled always is. Rows without ``ts`` or key are left out. A batch that is run again
    overwrites what it wrote, unless a later one was written too; ``target`` and ``checkpoint`` belong together. ``every`` sets a polling interval, else all input that is there is taken.
    """
    spark = stream.sparkSession
    day = F.floor(F.unix_millis(ts) / DAY_MS).alias("__day")
    at = F.unix_micros(ts).alias("__at")
    # The clock of its batch is noted with a row: of equal versions that of an earlier batch has the larger negative.
    order = ["__at", *([tie] if tie else []), -F.col("__clock"), -F.col("__nth")]
    known = stream.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select("*", day, at)
    rows = known.withColumns({"__clock": F.unix_micros(F.current_timestamp()), "__nth": _arrival()}).withWatermark(ts, delay)
    keys, delay_ms = [key, "__day"], _delay_ms(spark, delay)
    best = F.max_by(F.struct(*known.columns), F.struct(*order)).alias("__r")
    newest = rows.groupBy(F.col(key).alias("__key"), F.window(ts, "1 day")).agg(best).select("__r.*")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if (_newest_batch(session, f"{target}/open") or 0) > batch_id:
            batch.write.format("noop").mode("overwrite").save()  # run again for its state; a later batch has been written already
            return
        before = _open_rows(session, _slot(target, batch_id - 1))  # the other one is about to be overwritten
        # The newest row of all batches before is always an open one, so it tells the watermark of this batch.
        at = before.agg(F.max("__at")).first()[0] if before is not None else None
        over = (F.col("__day") + 1) * DAY_MS <= max(0, at // 1000 - delay_ms if at is not None else 0)
        snapshot = batch.where(~over)
        if before is not None:
            settled = before.where(over)
            if not settled.isEmpty():
                dated = settled.withColumn("day", F.date_from_unix_date(F.col("__day").cast("int"))).drop("__day", "__at")
                dated.write.mode("overwrite").partitionBy("day").parquet(f"{target}/settled/batch={batch_id}")
            # What state gives for a key is at least as new as what was open before.
            both = snapshot.select(*before.columns, F.lit(1).alias("__new")).unionByName(before.where(~over).withColumn("__new", F.lit(0)))
            snapshot = last_per_key(both, keys, ["__new"]).drop("__new")
        mark = session.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields])
        snapshot = snapshot.withColumn("__mark", F.lit(False)).unionByName(mark.withColumn("__mark", F.lit(True)))
        snapshot.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(_slot(target, batch_id))

    writer = newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    # State may outgrow memory, so it lies in this store; the query keeps the setting that it starts with.
    earlier = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if earlier is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, earlier)


def read_by_day(spark: SparkSession, target: str) -> DataFrame:
    """Newest version of every record and ``day``, settled or still open; a filter on ``day`` prunes settled files."""
    day = F.date_from_unix_date(F.col("__day").cast("int")).alias("day")
    open_rows = _open_rows(spark, f"{target}/open")
    if open_rows is None:
        raise ValueError(f"nothing written to {target} yet")
    current = open_rows.select(*[c for c in open_rows.columns if c not in ("__day", "__at")], day)
    if not _exists(spark, f"{target}/settled"):
        return current
    return current.unionByName(spark.read.parquet(f"{target}/settled").select(current.columns))
