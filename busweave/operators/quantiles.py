"""Exact quantiles and mid-ranks without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.operators.ordered import over_slices, running_sum
from busweave.session import checkpointed


#: Column with the number of the range partition of a row.
RANGE = "__range"


def ranged(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """``df`` written over range partitions of ``cols``, with their ascending numbers in ``RANGE``.

    The ranges come from Spark's own sample, so their number and borders follow the data. The numbers are written with
    the rows, so that every later read sees the same slices.
    """
    return checkpointed(df.repartitionByRange(*cols).withColumn(RANGE, F.spark_partition_id()), label)


def unpivot_values(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per (row, column): ``keys``, ``feature``, ``value``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in cols]))
    return df.select(*keys, pairs.alias("p")).select(*keys, F.col("p.f").alias("feature"), F.col("p.v").alias("value"))


def value_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Counts per key, feature and distinct value, with the range partition of the value."""
    counts = (
        unpivot_values(df, keys, cols)
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return ranged(counts, [*keys, "feature", "value"], "value-counts")


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles per key and column: ``keys, feature, <one column per prob>``.

    Distinct values are counted first; ranks come from running counts over value ranges, so a group
    that holds most rows is spread over many tasks.
    """
    keys = list(keys)
    counts = value_counts(df, keys, cols)
    by = [*keys, "feature"]
    ranked = over_slices(counts, by, ["value"], F.col(RANGE), upto=running_sum(F.col("n")))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    both = ranked.join(totals, by)
    start, end = F.col("upto") - F.col("n"), F.col("upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < end), F.col("value")))

    aggs = []
    for name, p in probs.items():
        rank = F.lit(p) * (F.col("total") - 1)
        aggs += [
            at(F.floor(rank)).alias(f"__lo_{name}"),
            at(F.ceil(rank)).alias(f"__hi_{name}"),
            F.max(rank - F.floor(rank)).alias(f"__w_{name}"),
        ]
    out = both.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"__lo_{n}") + F.col(f"__w_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n)
            for n in probs
        ],
    )


def mid_ranks(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mid-rank of every distinct value: ``keys, feature, value, n, mid_rank``."""
    keys = list(keys)
    counts = value_counts(df, keys, cols)
    ranked = over_slices(
        counts, [*keys, "feature"], ["value"], F.col(RANGE), upto=running_sum(F.col("n"))
    )
    return ranked.select(
        *keys, "feature", "value", "n", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("mid_rank")
    )
