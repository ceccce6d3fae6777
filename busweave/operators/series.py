"""Time-series framing: fills, sliding windows, chunks and smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from busweave.operators.ordered import last_seen, look_around, over_slices, position

# Cubic Savitzky-Golay weights for nine points, to be divided by 231.
SAVGOL_9_3 = (-21, 14, 39, 54, 59, 54, 39, 14, -21)
SAVGOL_NORM = 231.0
REACH = 4


def fill_from_previous_day(df: DataFrame, ts: str, column: str, tie: Sequence[str] = (), days_per_slice: int = 30) -> DataFrame:
    """Fill a missing reading with the last known one of the same minute on an earlier day."""
    second = F.col(ts).cast("long")
    keyed = df.withColumn("__minute", F.floor(second / 60) % 1440)
    cut = F.floor(second / (86400 * days_per_slice))
    filled = over_slices(keyed, ["__minute"], [ts, *tie], cut, __seen=last_seen(F.col(column)))
    return filled.withColumn(column, F.coalesce(column, "__seen")).select(*df.columns)


def sliding_frame(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, column: str, n: int
) -> DataFrame:
    """Supervised rows: the ``n`` values before (``x_1`` is the oldest) and the value itself as ``y``.
    Rows with fewer than ``n`` values before them drop out."""
    def back(k):
        return lambda w: F.lag(F.struct(column), k).over(w)

    lags = {f"__x_{i}": back(n - i + 1) for i in range(1, n + 1)}
    framed = look_around(df, keys, order, slice_by, n, 0, **lags)
    full = framed.where(F.col("__x_1").isNotNull())
    return full.select(
        *keys, *order, *[F.col(f"__x_{i}.{column}").alias(f"x_{i}") for i in range(1, n + 1)], F.col(column).alias("y")
    )


def chunk_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, k: int) -> DataFrame:
    """Tumbling chunks of ``k`` rows, numbered from 0."""
    placed = over_slices(df, keys, order, slice_by, __pos=position())
    return placed.withColumn("chunk", F.floor((F.col("__pos") - 1) / k)).drop("__pos")


def savgol_over(column: str, w: WindowSpec) -> Column:
    """Smoothed value over nine rows; past either end the series is continued by its mirror image."""
    around = F.array(
        *[F.lag(column, k).over(w) for k in range(REACH, 0, -1)],
        F.col(column),
        *[F.lead(column, k).over(w) for k in range(1, REACH + 1)],
    )
    before = sum((F.lag(column, k).over(w).isNotNull().cast("int") for k in range(1, REACH + 1)), F.lit(0))
    after = sum((F.lead(column, k).over(w).isNotNull().cast("int") for k in range(1, REACH + 1)), F.lit(0))
    first, last = F.get(around, REACH - before), F.get(around, REACH + after)

    def term(k: int) -> Column:
        if k < 0:
            mirrored = first - F.abs(F.get(around, F.lit(REACH - k) - 2 * before) - first)
        else:
            mirrored = last + F.abs(F.get(around, F.lit(REACH - k) + 2 * after) - last)
        return F.coalesce(F.get(around, F.lit(REACH + k)), mirrored)

    weighted = [SAVGOL_9_3[k + REACH] * (term(k) if k else F.col(column)) for k in range(-REACH, REACH + 1)]
    return sum(weighted[1:], weighted[0]) / SAVGOL_NORM


def savgol(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, column: str, name: str = "smooth"
) -> DataFrame:
    return look_around(df, keys, order, slice_by, REACH, REACH, **{name: lambda w: savgol_over(column, w)})
