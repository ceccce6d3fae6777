"""Time arithmetic as Column expressions on full timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday names by number, Monday first.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
OLE_EPOCH_S = -2209161600  # 1899-12-30 00:00:00


def epoch_s(ts: Column) -> Column:
    return ts.cast("timestamp").cast("long")


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from ``a`` to ``b``, truncated toward zero."""
    seconds = epoch_s(b) - epoch_s(a)
    return (F.signum(seconds.cast("double")) * F.floor(F.abs(seconds) / 60)).cast("long")


def seconds_mod_day(a: Column, b: Column) -> Column:
    return F.pmod(b - a, F.lit(86400))


def hhm_bucket(ts: Column, colon: bool = False) -> Column:
    """Ten-minute tag: hour and first digit of the minute."""
    return F.substring(F.date_format(ts, "HH:mm" if colon else "HHmm"), 1, 4 if colon else 3)


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def hour_date_key(ts: Column) -> Column:
    return F.date_format(ts, "HH:yyyy-MM-dd")


def previous_day(text: Column) -> Column:
    return F.date_format(F.date_sub(F.to_date(text, "yyyy_MM_dd"), 1), "yyyy_MM_dd")


def day_first(text: Column) -> Column:
    """``dd-MM-yyyy`` to ``yyyy-MM-dd``."""
    return F.date_format(F.to_date(text, "dd-MM-yyyy"), "yyyy-MM-dd")


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def day_number(ts: Column) -> Column:
    """Days with fraction since 1899-12-30."""
    return (epoch_s(ts) - OLE_EPOCH_S) / 86400.0


def weekday_name(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)


def calendar_day_index(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock_seconds(text: Column) -> Column:
    """``H:m:s`` text, hours may pass 24; malformed text gives null."""
    parts = F.split(text, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def date_parts(df: DataFrame, cols: list[str], drop: bool = True) -> DataFrame:
    """Replace each timestamp by its day, month, year and weekday (Monday 0)."""
    new = {}
    for c in cols:
        new[f"{c}_day"] = F.dayofmonth(c)
        new[f"{c}_month"] = F.month(c)
        new[f"{c}_year"] = F.year(c)
        new[f"{c}_weekday"] = F.weekday(F.col(c))
    out = df.withColumns(new)
    return out.drop(*cols) if drop else out
