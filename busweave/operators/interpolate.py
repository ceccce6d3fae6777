"""Passing times at shape points and stops between matched pings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busweave.operators.ordered import blocks_of, last_seen, next_seen, over_slices

BETWEEN = "BETWEEN"


def interpolate_times(
    df: DataFrame, keys: Sequence[str], seq: str = "seq", dist: str = "dist", at_ms: str = "at_ms", block: int = 512
) -> DataFrame:
    """Add ``est_ms``: the known time, or the linear share of the distance between the known
    neighbours, in whole milliseconds. Points outside the first and last known time stay null, as do
    points between neighbours at the same distance. ``interpolated`` marks computed times.
    """
    known = F.when(F.col(at_ms).isNotNull(), F.struct(F.col(dist).alias("d"), F.col(at_ms).alias("t")))
    around = over_slices(
        df, list(keys), [seq], blocks_of(seq, block), __p=last_seen(known), __n=next_seen(known)
    )
    d, dp, tp, dn, tn = (F.col(c) for c in (dist, "__p.d", "__p.t", "__n.d", "__n.t"))
    step = F.try_divide((d - dp) * (tn - tp), dn - dp).cast("long")
    return around.withColumns(
        {
            "est_ms": F.when(F.col(at_ms).isNotNull(), F.col(at_ms)).otherwise(tp + step),
            "interpolated": F.col(at_ms).isNull() & (tp + step).isNotNull(),
        }
    ).drop("__p", "__n")


def stops_only(df: DataFrame, stops: DataFrame, on: Sequence[str] = ("shape", "seq"), problem: str = "problem") -> DataFrame:
    """Rows that are stops, with interpolated ones labelled ``BETWEEN``."""
    joined = df.join(stops, list(on))
    label = F.when(F.col("interpolated"), F.lit(BETWEEN))
    return joined.withColumn(problem, F.coalesce(label, F.col(problem)) if problem in df.columns else label)
