"""The option closest in time to each row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.functions.times import epoch_s
from busweave.operators.nearest import sized
from busweave.session import checkpointed


def closest_in_time(
    rows: DataFrame,
    options: DataFrame,
    on: Sequence[str],
    row_id: Sequence[str],
    ts: str,
    option_ts: str,
    prefer: Sequence[str],
    take: Sequence[str],
    valid: Callable[[Column], Column] | None = None,
    skip: int = 0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``rows`` plus ``take`` of the option of equal ``on`` that is fewest whole minutes away; nulls where none is valid.

    Ties go to the smallest ``option_ts``, then ``prefer``, then ``take``. ``valid`` judges the whole minutes from row to
    option; on either side of the row it must not turn true again further away (``skip``: seconds after the row before
    which no later option is valid). Rows of one ``row_id`` are one row. ``keep``: columns of ``rows`` that are returned
    beside ``row_id``, by default all.

    No row meets the options one by one. The answer depends on key and second only, so rows and options are reduced to
    distinct seconds; of the options after a second only the first can win, and of those before it the first that is
    as many whole minutes away as the last. That one lies at most 59 seconds before the last, so each option brings the
    seconds of options that close before it. Windows see seconds, not values: a second's option is joined when it has won.
    A window holds the seconds of one key: ``on`` should bound them, by an hour.
    """
    on, row_id = list(on), list(row_id)
    columns = rows.columns if keep is None else [*row_id, *[c for c in keep if c not in row_id]]
    best = F.min(F.struct(F.col(option_ts).alias("__at"), *[F.col(c).alias(f"__p_{c}") for c in prefer], *[F.col(c).alias(f"__t_{c}") for c in take]))
    known = options.dropna(subset=on).where(F.col(option_ts).isNotNull())
    told = checkpointed(known.groupBy(*on, epoch_s(F.col(option_ts)).alias("__s")).agg(best.alias("__v")), "option-seconds")

    asked = rows.select(*on, epoch_s(F.col(ts)).alias("__s")).dropna().distinct()
    seconds = told.select(*on, "__s", F.col("__s").alias("__told")).unionByName(asked.withColumn("__told", F.lit(None).cast("long")))
    by_second = Window.partitionBy(*on).orderBy("__s")
    earlier = by_second.rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*on).orderBy(F.col("__s").desc()).rangeBetween(Window.unboundedPreceding, -skip)
    close = seconds.withColumn("__close", F.collect_list("__told").over(by_second.rangeBetween(-59, 0)))
    around = close.withColumns(
        {"__last": F.last(F.when(F.col("__told").isNotNull(), F.struct("__told", "__close")), ignorenulls=True).over(earlier), "__next": F.min("__told").over(later)}
    ).where("__told IS NULL")
    # Seconds as many whole minutes before the row as the last option begin here.
    start = F.col("__s") - F.floor((F.col("__s") - F.col("__last.__told")) / 60) * 60 - 59
    first = F.array_min(F.filter("__last.__close", lambda second: second >= start))

    def scored(second: Column) -> Column:
        away = second - F.col("__s")
        minutes = (F.signum(away.cast("double")) * F.floor(F.abs(away) / 60)).cast("long")
        usable = second.isNotNull() if valid is None else second.isNotNull() & valid(minutes)
        return F.when(usable, F.struct(F.abs(minutes).alias("__gap"), second.alias("__won")))

    winner = F.least(scored(first), scored(F.col("__next")))
    won = around.select(*on, "__s", winner.alias("__w")).where("__w IS NOT NULL").select(*on, "__s", "__w.__gap", "__w.__won")
    values = sized(told.withColumnRenamed("__s", "__won"), told.count())
    met = won.join(values, [*on, "__won"]).select(*on, "__s", F.struct("__gap", "__v").alias("__best"))
    joined = rows.withColumn("__s", epoch_s(F.col(ts))).join(met, [*on, "__s"], "left")
    own = [c for c in columns if c not in row_id]
    kept = {"__row": F.struct(*own)} if own else {}
    joined = joined.select(*[F.col(c).alias(f"__id_{c}") for c in row_id], *[c.alias(n) for n, c in kept.items()], "__best")
    found = joined.groupBy(*[f"__id_{c}" for c in row_id]).agg(*[F.any_value(n).alias(n) for n in kept], F.min("__best").alias("__best"))
    # Ids come from the grouping, so that a join by them needs no further shuffle.
    return found.select(
        *[F.col(f"__id_{c}" if c in row_id else f"__row.{c}").alias(c) for c in columns], *[F.col(f"__best.__v.__t_{c}").alias(c) for c in take]
    )
