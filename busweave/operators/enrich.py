"""Weather, alert and jam reports attached to stop visits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.functions.geo import haversine_m
from busweave.operators.best import closest_in_time
from busweave.operators.nearest import nearest_point
from busweave.operators.shaping import first_per_key
from busweave.operators.streets import containing_pairs


def nearest_station(df: DataFrame, stations: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """Nearest weather station of each row: ``station`` and ``station_m``; the smallest id wins ties."""
    return nearest_point(df, stations, row_id, [], ["station"], ["station"], distance="station_m")


def asof_weather(df: DataFrame, readings: DataFrame, row_id: Sequence[str], ts: str = "ts", keep: Sequence[str] | None = None) -> DataFrame:
    """Reading of the row's station that is closest in whole minutes. ``keep``: as in ``closest_in_time``.

    Readings of the same hour are used; if there are none, those of the next later hour of the day
    that has some, else of the nearest earlier one. The earliest reading wins ties. A station
    without readings on the day gives null.
    """
    keyed = readings.select(
        "station", F.to_date("ts").alias("__day"), F.hour("ts").alias("__source"), F.col("ts").alias("reading_ts"), "precipitation",
        F.col("ts").cast("long").alias("__second"),
    )
    single = first_per_key(keyed, ["station", "__day", "__source", "__second"], ["reading_ts", "precipitation"])
    hours = single.groupBy("station", "__day").agg(F.collect_set("__source").alias("__hours"))
    later = F.array_min(F.filter("__hours", lambda h: h >= F.col("__hour")))
    earlier = F.array_max(F.filter("__hours", lambda h: h < F.col("__hour")))
    target = (
        hours.withColumn("__hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .withColumn("__source", F.coalesce(later, earlier))
        .drop("__hours")
    )
    options = target.join(single, ["station", "__day", "__source"]).drop("__source", "__second")
    rows = df.withColumns({"__day": F.to_date(ts), "__hour": F.hour(ts)})
    kept = df.columns if keep is None else keep
    return closest_in_time(
        rows, options, ["station", "__day", "__hour"], row_id, ts, "reading_ts", [], ["precipitation", "reading_ts"], keep=kept
    )


def _by_street(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` once per street name of ``rows`` that their ``report_street`` holds, as ``street``.

    Distinct names meet distinct streets once, whatever the number of cells and hours they occur in.
    """
    names = rows.where(F.col("street") != "-").select(F.col("street").alias("name"))
    streets = reports.where(F.col("report_street") != "").select(F.col("report_street").alias("text"))
    pairs = containing_pairs(names, streets).select(F.col("name").alias("street"), F.col("text").alias("report_street"))
    return reports.join(pairs, "report_street")


def match_alerts(
    df: DataFrame,
    alerts: DataFrame,
    row_id: Sequence[str],
    take: Sequence[str],
    ts: str = "ts",
    before_min: int = 60,
    after_min: int = 10,
    distance: bool = True,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Closest alert in time of the same cell whose street holds the row's street.

    ``alerts`` has ``cell``, ``street``, ``ts``, ``alert_id``, ``lat``, ``lon`` and the ``take``
    columns. An alert counts if it is less than ``before_min`` minutes older or less than
    ``after_min`` minutes newer. Cell and hour are equality keys, so only reports near in place and
    time are met; each alert is listed under the hours it can serve. ``keep``: as in ``closest_in_time``; ``distance``
    needs ``lat`` and ``lon`` among it.
    """
    hour_of = lambda c: F.floor(F.col(c).cast("long") / 3600)
    reach_back = -(-after_min // 60)
    reach_on = -(-before_min // 60)
    named = alerts.select(
        "cell",
        F.col("street").alias("report_street"),
        F.col("ts").alias("alert_ts"),
        F.col("lat").alias("alert_lat"),
        F.col("lon").alias("alert_lon"),
        "alert_id",
        *[c for c in take if c != "alert_id"],
    )
    hours = F.sequence(hour_of("alert_ts") - reach_back, hour_of("alert_ts") + reach_on)
    rows = df.withColumn("__hour", hour_of(ts))
    keys = ["cell", "__hour"]
    options = _by_street(df, named).withColumn("__hour", F.explode(hours))
    found = closest_in_time(
        rows,
        options,
        [*keys, "street"],
        row_id,
        ts,
        "alert_ts",
        ["alert_id"],
        ["alert_ts", "alert_lat", "alert_lon", *take],
        lambda gap: ((gap <= 0) & (F.abs(gap) < before_min)) | ((gap > 0) & (gap < after_min)),
        skip=0 if before_min > 0 else 60,
        keep=df.columns if keep is None else keep,
    )
    if not distance:
        return found
    return found.withColumn("alert_m", F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("alert_lat"), F.col("alert_lon")), 3))


def match_jams(
    df: DataFrame,
    jams: DataFrame,
    row_id: Sequence[str],
    take: Sequence[str],
    ts: str = "ts",
    window_min: int = 60,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Closest jam in time of the same date and hour whose street holds the row's street. ``keep``: as in ``closest_in_time``."""
    listed = jams.select(
        F.to_date("ts").alias("__day"),
        F.hour("ts").alias("__hour"),
        F.col("street").alias("report_street"),
        F.col("ts").alias("jam_ts"),
        "jam_id",
        *[c for c in take if c != "jam_id"],
    )
    rows = df.withColumns({"__day": F.to_date(ts), "__hour": F.hour(ts)})
    keys = ["__day", "__hour"]
    options = _by_street(rows, listed)
    kept = df.columns if keep is None else keep
    return closest_in_time(
        rows, options, [*keys, "street"], row_id, ts, "jam_ts", ["jam_id"], ["jam_ts", *take], lambda gap: F.abs(gap) < window_min, keep=kept
    )


# What a row without a report gets.
ALERT_DEFAULTS = {"alert_type": "NORMAL", "alert_subtype": "NORMAL", "alert_confidence": 5, "alert_reliability": 10, "alert_rating": 5.0}
JAM_DEFAULTS = {"jam_block_type": "NORMAL", "jam_delay": 0, "jam_length": 0, "jam_level": 0, "jam_severity": 0}


def with_default_reports(df: DataFrame, ts: str = "ts", at: tuple[str, str] = ("lat", "lon"), distance: str = "distance_m") -> DataFrame:
    """Fill missing alert and jam columns: neutral constants, the row's own time, place and distance."""
    own: dict[str, Column] = {
        "alert_ts": F.col(ts),
        "alert_lat": F.col(at[0]),
        "alert_lon": F.col(at[1]),
        "alert_m": F.col(distance) if distance in df.columns else F.lit(None),
        "jam_ts": F.col(ts),
    }
    fills = {**own, **{c: F.lit(v) for c, v in {**ALERT_DEFAULTS, **JAM_DEFAULTS}.items()}}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fills.items() if c in df.columns})
