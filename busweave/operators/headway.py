"""Headway between consecutive vehicles at a stop, and the bunching label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.functions.times import calendar_day_index, minutes_between
from busweave.operators.ordered import following, hours, over_slices, position
from busweave.session import checkpointed

# Share of the scheduled headway and default minutes below which buses are bunched.
BUNCHING_DIVISOR = 4
DEFAULT_THRESHOLD_MIN = 5
#: Scheduled intervals, counted once for each time bucket they touch, up to which a timetable is looked up as lists.
LIST_ENTRIES = 200_000


def next_bus_headway(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    bus: str = "bus",
    carry: Sequence[str] | None = None,
    compat: bool = False,
    slice_s: int = 3600,
) -> DataFrame:
    """Pair each visit with the next one of its key; visits followed by the same vehicle drop out.

    ``sb`` holds ``carry`` (default: all columns) of the next visit and ``headway_min`` whole minutes.
    ``compat`` also drops the last two visits of every key.
    """
    cols = list(dict.fromkeys([ts, bus, *(carry if carry is not None else df.columns)]))
    values = {"sb": following(*cols)}
    if compat:
        values["__next2"] = following(ts)
    paired = over_slices(df, keys, [ts, bus], hours(ts, slice_s), **values)
    if compat:
        total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        placed = over_slices(df, keys, [ts, bus], hours(ts, slice_s), sb=following(*cols), __pos=position())
        paired = placed.join(total, list(keys)).where(F.col("__pos") <= F.col("__n") - 2).drop("__pos", "__n")
    apart = paired.where(F.col("sb").isNotNull() & (F.col(bus) != F.col(f"sb.{bus}")))
    return apart.withColumn("headway_min", minutes_between(F.col(ts), F.col(f"sb.{ts}")))


def bunching_threshold(scheduled_min: Column | None, default: int, divisor: int) -> Column:
    fallback = F.lit(default).cast("long")
    if scheduled_min is None:
        return fallback
    return F.coalesce(F.floor(scheduled_min / divisor), fallback)


def label_bunching(
    df: DataFrame,
    headway: str = "headway_min",
    scheduled: str | None = None,
    default_threshold: int = DEFAULT_THRESHOLD_MIN,
    divisor: int = BUNCHING_DIVISOR,
) -> DataFrame:
    """Add ``threshold_min`` and ``bunched``: headway at or below the threshold."""
    planned = F.col(scheduled) if scheduled else None
    return df.withColumn("threshold_min", bunching_threshold(planned, default_threshold, divisor)).withColumn(
        "bunched", F.col(headway) <= F.col("threshold_min")
    )


def flatten_next(df: DataFrame, suffix: str = "SB") -> DataFrame:
    """Spread the ``sb`` struct over columns with a suffix."""
    fields = df.schema["sb"].dataType.fieldNames()
    return df.select(
        *[F.col(c) for c in df.columns if c != "sb"], *[F.col(f"sb.{f}").alias(f"{f}{suffix}") for f in fields]
    )


def scheduled_headways(
    stop_times: DataFrame,
    keys: Sequence[str] = ("route", "shape_id", "stop_id", "service_id"),
    arrival: str = "arrival_s",
    tie: Sequence[str] = (),
    distinct: bool = False,
    compat: bool = False,
    slice_s: int = 900,
) -> DataFrame:
    """Consecutive scheduled arrivals per key: ``first_arr``, ``second_arr``, ``sched_min``.

    ``distinct`` removes repeated arrivals first; ``compat`` skips the last pair of a key unless the
    key has exactly two arrivals.
    """
    keys = list(keys)
    rows = stop_times.select(*keys, arrival, *tie)
    if distinct:
        rows, tie = rows.select(*keys, arrival).distinct(), ()
    values = {"__next": following(arrival)}
    if compat:
        values["__pos"] = position()
    paired = over_slices(rows, keys, [arrival, *tie], F.floor(F.col(arrival) / slice_s), **values)
    if compat:
        total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        paired = paired.join(total, keys).where((F.col("__n") == 2) | (F.col("__pos") < F.col("__n") - 1))
    return paired.where(F.col("__next").isNotNull()).select(
        *keys,
        F.col(arrival).alias("first_arr"),
        F.col(f"__next.{arrival}").alias("second_arr"),
        F.floor((F.col(f"__next.{arrival}") - F.col(arrival)) / 60).alias("sched_min"),
    )


def scheduled_headway_for(
    pairs: DataFrame,
    scheduled: DataFrame,
    row_id: str,
    keys: Sequence[str],
    first_s: str = "t1_s",
    second_s: str = "t2_s",
    bucket_s: int = 3600,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Scheduled headway of the earliest interval that holds both passing times, else null.

    Intervals are spread over the time buckets they touch, so the join is an equi-join on the keys
    and a bucket instead of all intervals of a key. Pairs that pass midnight lie in no interval. Pairs of one
    ``row_id`` share the earliest interval that any of them has. Up to ``LIST_ENTRIES`` of a timetable are listed by key
    and bucket, and pairs are neither shuffled nor repeated to look them up; ``ids`` are the rows that the pairs were
    made of, by default the pairs, among which repeated ids are sought.
    """
    keys = list(keys)
    spread = scheduled.withColumn(
        "__b",
        F.explode(
            F.sequence(F.floor(F.col("first_arr") / bucket_s), F.floor(F.col("second_arr") / bucket_s))
        ),
    ).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__b", "first_arr", "second_arr", "sched_min")
    spread = checkpointed(spread.distinct(), "intervals")
    bucket = F.when(F.col(first_s) <= F.col(second_s), F.floor(F.col(first_s) / bucket_s))
    same = F.col("__pb") == F.col("__b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    hit = ["first_arr", "second_arr", "sched_min"]
    if spread.count() <= LIST_ENTRIES:
        listed = [f"__k_{k}" for k in keys] + ["__b"]
        lists = checkpointed(spread.groupBy(*listed).agg(F.sort_array(F.collect_list(F.struct(*hit))).alias("__list")), "interval-lists")
        holds = lambda i: (i["first_arr"] <= F.col(first_s)) & (F.col(second_s) <= i["second_arr"])
        found = pairs.withColumn("__pb", bucket).join(lists, same, "left")
        found = found.withColumn("__hit", F.get(F.filter("__list", holds), 0)).drop("__pb", "__list", *listed)
        repeated = checkpointed(
            (pairs if ids is None else ids).groupBy(row_id).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(row_id), "repeated-ids"
        )
        if not repeated.isEmpty():
            shared = found.join(repeated, row_id, "left_semi").groupBy(row_id).agg(F.min("__hit").alias("__shared"))
            found = found.join(shared, row_id, "left").withColumn("__hit", F.coalesce("__shared", "__hit"))
        sched = F.when(F.col(row_id).isNotNull(), F.col("__hit.sched_min"))
        return found.select(row_id, *[c for c in pairs.columns if c != row_id], sched.alias("sched_min"))
    rows = pairs.withColumn("__pb", bucket).where("__pb IS NOT NULL")
    on = same & (F.col("first_arr") <= F.col(first_s)) & (F.col(second_s) <= F.col("second_arr"))
    hits = (
        rows.join(spread, on)
        .groupBy(row_id)
        .agg(F.min(F.struct(*hit)).alias("__hit"))
        .select(row_id, F.col("__hit.sched_min").alias("sched_min"))
    )
    return pairs.join(hits, row_id, "left")


def service_for_day(
    df: DataFrame, calendar: DataFrame, ts: str = "ts", default: int = 1, check_start: bool = False
) -> DataFrame:
    """First service whose weekday flag is set and whose end date is not past; default otherwise.

    Services are resolved once per distinct date and written, so that Spark sees how few they are when it joins them back.
    """
    flags = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    active = calendar.select(
        "service_id",
        "start_date",
        "end_date",
        F.explode(F.array(*[F.struct(F.lit(i + 1).alias("d"), F.col(f).alias("on")) for i, f in enumerate(flags)])).alias(
            "w"
        ),
    ).where(F.col("w.on") == 1)
    dated = df.withColumn("__date", F.to_date(ts))
    days = dated.select("__date").distinct().withColumn("__dow", calendar_day_index(F.col("__date")))
    valid = (F.col("__dow") == F.col("w.d")) & (F.col("__date") <= F.col("end_date"))
    if check_start:
        valid = valid & (F.col("__date") >= F.col("start_date"))
    resolved = days.join(active, valid).groupBy("__date").agg(F.min("service_id").alias("__service"))
    return (
        dated.join(checkpointed(resolved, "services"), "__date", "left")
        .withColumn("service_id", F.coalesce("__service", F.lit(default)))
        .drop("__date", "__service")
    )
