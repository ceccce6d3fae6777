"""Stop visits with weather, traffic reports, timetable and label: rows of 44 and 89 columns, and features of them.

Every lookup works on narrow rows (id, time, place, street); the wide visit is joined once, at the end. Visits need
``visit_id`` (unique), ``day``, ``route``, ``trip_num``, ``shape``, ``frequency``, ``seq``, ``shape_lat``, ``shape_lon``,
``dist``, ``bus``, ``gps_id``, ``gps_lat``, ``gps_lon``, ``distance_m``, ``ts``, ``stop``, ``problem``, ``cell``, ``street``;
an interpolated visit has no ping, so its four ping columns are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busweave.functions.geo import haversine_m
from busweave.functions.times import seconds_of_day
from busweave.operators import enrich as E
from busweave.operators.features import booleans_to_int, fill_missing, impute_group_median
from busweave.operators.headway import (
    flatten_next,
    label_bunching,
    next_bus_headway,
    scheduled_headway_for,
    service_for_day,
)
from busweave.session import checkpointed

# Columns of an integrated row, in order, with the name of each inside the library.
GPS_PART = {
    "route": "route",
    "tripNum": "trip_num",
    "shapeId": "shape",
    "routeFrequency": "frequency",
    "shapeSequence": "seq",
    "shapeLat": "shape_lat",
    "shapeLon": "shape_lon",
    "distanceTraveledShape": "dist",
    "busCode": "bus",
    "gpsPointId": "gps_id",
    "gpsLat": "gps_lat",
    "gpsLon": "gps_lon",
    "distanceToShapePoint": "distance_m",
    "gps_datetime": "ts",
    "stopPointId": "stop",
    "problem": "problem",
}
WEATHER_PART = {"precipitation": "precipitation", "precipitationTime": "reading_ts", "precipitationStationDistance": "station_m"}
ALERT_PART = {
    "alertDateTime": "alert_ts",
    "alertSubtype": "alert_subtype",
    "alertType": "alert_type",
    "alertRoadType": "alert_road_type",
    "alertConfidence": "alert_confidence",
    "alertNComments": "alert_comments",
    "alertNImages": "alert_images",
    "alertNThumbsUp": "alert_thumbs",
    "alertReliability": "alert_reliability",
    "alertReportMood": "alert_mood",
    "alertReportRating": "alert_rating",
    "alertSpeed": "alert_speed",
    "alertLatitude": "alert_lat",
    "alertLongitude": "alert_lon",
    "alertDistanceToClosestShapePoint": "alert_m",
    "alertIsJamUnifiedAlert": "alert_unified",
    "alertInScale": "alert_in_scale",
}
JAM_PART = {
    "jamUpdateDateTime": "jam_ts",
    "jamExpirationDateTime": "jam_expiry",
    "jamBlockType": "jam_block_type",
    "jamDelay": "jam_delay",
    "jamLength": "jam_length",
    "jamLevel": "jam_level",
    "jamSeverity": "jam_severity",
    "jamSpeedKM": "jam_speed",
}
INTEGRATED = {**GPS_PART, **WEATHER_PART, **ALERT_PART, **JAM_PART}
LABEL_PART = {"headway": "headway_min", "headwayThreshold": "threshold_min", "busBunching": "bunched", "GPShour": "gps_hour"}
NOT_OF_NEXT = ("route", "shapeId", "routeFrequency")
NEXT = {k: v for k, v in INTEGRATED.items() if k not in NOT_OF_NEXT}
# Timestamps whose parts become features, the timestamps left out, and the parts' names.
DATED = ("gps_datetime", "precipitationTime", "alertDateTime", "jamUpdateDateTime")
UNDATED = ("jamExpirationDateTime",)
PARTS = {"DAY": F.dayofmonth, "YEAR": F.year, "MONTH": F.month, "WEEKDAY": F.weekday}

_ALERT_TAKE = [v for v in ALERT_PART.values() if v not in ("alert_ts", "alert_lat", "alert_lon", "alert_m")]
_JAM_TAKE = [v for v in JAM_PART.values() if v != "jam_ts"]


def _where_none(df: DataFrame, found: str, defaults: dict) -> DataFrame:
    """The whole default report where none was found; a found report keeps its own nulls."""
    return df.withColumns({c: F.when(F.col(found).isNull(), v).otherwise(F.col(c)) for c, v in defaults.items()})


def integrate(visits: DataFrame, stations: DataFrame, readings: DataFrame, alerts: DataFrame, jams: DataFrame) -> DataFrame:
    """``visits`` with the reading of the nearest station, the closest alert and the closest jam.

    Places are those of the shape point, which interpolated visits have too. A visit without a report gets a neutral
    one with its own time and ping; one without a reading keeps nulls. No visit is dropped or repeated.
    """
    narrow = checkpointed(
        visits.select("visit_id", "ts", "cell", "street", F.col("shape_lat").alias("lat"), F.col("shape_lon").alias("lon")), "narrow"
    )
    near = E.nearest_station(narrow.select("visit_id", "ts", "lat", "lon"), stations, ["visit_id"])
    weather = E.asof_weather(near.drop("lat", "lon"), readings, ["visit_id"], keep=["station_m"])
    alert = E.match_alerts(narrow.drop("lat", "lon"), alerts, ["visit_id"], _ALERT_TAKE, distance=False, keep=[])
    jam = E.match_jams(narrow.select("visit_id", "ts", "street"), jams, ["visit_id"], _JAM_TAKE, keep=[])
    rows = visits.join(weather, "visit_id").join(alert, "visit_id").join(jam, "visit_id")
    away = haversine_m(F.col("shape_lat"), F.col("shape_lon"), F.col("alert_lat"), F.col("alert_lon"))
    rows = rows.withColumn("alert_m", F.round(away, 3))
    neutral = {c: F.lit(v) for c, v in E.ALERT_DEFAULTS.items()}
    own = {"alert_lat": F.col("gps_lat"), "alert_lon": F.col("gps_lon"), "alert_m": F.col("distance_m")}
    rows = _where_none(rows, "alert_ts", {**neutral, **own})
    rows = _where_none(rows, "jam_ts", {c: F.lit(v) for c, v in E.JAM_DEFAULTS.items()})
    return rows.withColumns({"alert_ts": F.coalesce("alert_ts", "ts"), "jam_ts": F.coalesce("jam_ts", "ts")})


def label_visits(
    rows: DataFrame,
    scheduled: DataFrame,
    calendar: DataFrame,
    keys: Sequence[str] = ("route", "shape", "stop"),
    carry: Sequence[str] = tuple(NEXT.values()),
) -> DataFrame:
    """Integrated visits followed by another bus: next visit ``sb``, headway, threshold and label.

    ``scheduled`` has the intervals of ``scheduled_headways`` by ``keys`` and ``service_id``. The threshold is a share of
    the interval that holds both passing times on the service of the day, or the default where none does. Visits
    are paired within a service day. ``carry``: columns of the next visit, by default all it can have.
    """
    keys = list(keys)
    # Services first: their dates come from the rows as they are, not from rows paired a second time.
    paired = next_bus_headway(service_for_day(rows, calendar), ["day", *keys], carry=list(dict.fromkeys(carry)))
    timed = paired.withColumns(
        {"t1_s": seconds_of_day(F.col("ts")), "t2_s": seconds_of_day(F.col("sb.ts")), "gps_hour": F.hour("ts")}
    )
    planned = scheduled_headway_for(timed, scheduled, "visit_id", [*keys, "service_id"], ids=rows)
    return label_bunching(planned, scheduled="sched_min").drop("t1_s", "t2_s", "service_id", "sched_min")


def integrated_columns(rows: DataFrame) -> DataFrame:
    """The 44 columns of an integrated row, by their output names."""
    return rows.select(*[F.col(v).alias(k) for k, v in INTEGRATED.items()])


def labelled_columns(labelled: DataFrame) -> DataFrame:
    """The 89 columns of a labelled row: the 44, the label's four, and 41 of the next bus with suffix ``SB``, of those carried."""
    own = [F.col(v).alias(k) for k, v in {**INTEGRATED, **LABEL_PART}.items()]
    carried = set(labelled.schema["sb"].dataType.fieldNames())
    return flatten_next(labelled.select(*own, F.struct(*[F.col(f"sb.{v}").alias(k) for k, v in NEXT.items() if v in carried]).alias("sb")))


def with_date_features(df: DataFrame, suffixes: Sequence[str] = ("", "SB")) -> DataFrame:
    """89 to 111 columns: day, year, month and weekday (Monday 0) in place of each timestamp there is."""
    dated = [c + s for s in suffixes for c in DATED if c + s in df.columns]
    parts = {f"{name}({c})": part(F.col(c)) for c in dated for name, part in PARTS.items()}
    return df.withColumns(parts).drop(*dated, *[c + s for s in suffixes for c in UNDATED])


def model_rows(df: DataFrame, suffixes: Sequence[str] = ("", "SB"), weekday: str = "WEEKDAY(gps_datetime)") -> DataFrame:
    """Rows of ``with_date_features`` without gaps: flags as 0 and 1, pings that are missing replaced by the shape point,
    then every numeric gap by the median of the row's weekday. A number that is null all through a weekday stays null.
    """
    flags = [c + s for s in suffixes for c in ("alertIsJamUnifiedAlert", "alertInScale")]
    out = booleans_to_int(df, [*flags, "busBunching"])
    fills: dict[str, str | int] = dict.fromkeys([*flags, "busBunching"], 0)
    for s in suffixes:
        fills |= {f"gpsPointId{s}": 0, f"distanceToShapePoint{s}": 0, f"alertDistanceToClosestShapePoint{s}": 0}
        fills |= {f"{c}{at}{s}": f"shape{by}{s}" for c, at, by in (("gps", "Lat", "Lat"), ("gps", "Lon", "Lon"), ("alert", "Latitude", "Lat"), ("alert", "Longitude", "Lon"))}
    out = fill_missing(out, fills)
    numbers = [f.name for f in out.schema if f.dataType.typeName() in ("integer", "long", "float", "double") and f.name != weekday and f.name not in fills]
    # One row says which columns have gaps; only those need medians.
    gaps = out.agg(*[F.count_if(F.col(c).isNull()).alias(str(i)) for i, c in enumerate(numbers)]).first()
    return impute_group_median(out, [c for i, c in enumerate(numbers) if gaps[i]], [weekday])
