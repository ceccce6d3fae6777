"""Projections, filters, sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.functions.geo import utm_to_latlon
from busweave.operators.ordered import over_slices, position

# Columns of the common ping layout, line code of vehicles out of service, trip problem label.
GPS_COLUMNS = ("bus_code", "latitude", "longitude", "timestamp", "line_code", "gps_id")
OUT_OF_SERVICE = "REC"
TRIP_PROBLEM = "TRIP_PROBLEM"

# Source column of each common ping column, by city.
GPS_MAPPINGS = {
    "campina_grande": {
        "bus_code": "vehicleId",
        "latitude": "lat",
        "longitude": "lon",
        "timestamp": "positionTime",
        "line_code": "routeId",
    },
    "recife": {
        "bus_code": "Unidad",
        "latitude": "CoordX",
        "longitude": "CoordY",
        "timestamp": "Instante",
        "line_code": "Linea",
    },
    "curitiba": {
        "bus_code": "VEIC",
        "latitude": "LAT",
        "longitude": "LON",
        "timestamp": "DTHR",
        "line_code": "COD_LINHA",
    },
}

# Feature groups of the integrated rows, and the timestamps whose parts belong to each.
FEATURE_GROUPS = {
    "gps": (
        "route", "tripNum", "shapeId", "busCode", "gpsPointId", "gpsLat", "gpsLon", "distanceToShapePoint", "problem",
        "headway", "headwayThreshold", "busBunching", "GPShour",
    ),
    "gtfs": ("routeFrequency", "shapeSequence", "shapeLat", "shapeLon", "distanceTraveledShape", "stopPointId"),
    "weather": ("precipitation", "precipitationStationDistance"),
    "traffic": (
        "alertSubtype", "alertType", "alertRoadType", "alertConfidence", "alertNComments", "alertNImages", "alertNThumbsUp",
        "alertReliability", "alertReportMood", "alertReportRating", "alertSpeed", "alertLatitude", "alertLongitude",
        "alertDistanceToClosestShapePoint", "alertIsJamUnifiedAlert", "alertInScale", "jamBlockType", "jamDelay", "jamLength",
        "jamLevel", "jamSeverity", "jamSpeedKM",
    ),
}
FEATURE_DATES = {"gps": ("gps_datetime",), "weather": ("precipitationTime",), "traffic": ("alertDateTime", "jamUpdateDateTime")}


# --- projections -------------------------------------------------------------------------------


def standardise_gps(df: DataFrame, mapping: dict[str, str], gps_id: str | None = None, utm_zone: int | None = None) -> DataFrame:
    """Project a city's raw pings to the common columns.

    With ``utm_zone`` (of the southern half) the source columns of latitude and longitude are planar easting and northing, of one
    city, and become degrees; a zero, missing or unreadable one gives nulls.
    """
    columns = {dst: F.col(src) for dst, src in mapping.items()}
    if utm_zone is not None:
        east, north = (columns[c].try_cast("double") for c in ("latitude", "longitude"))
        columns["latitude"], columns["longitude"] = utm_to_latlon(east, north, utm_zone)
    cols = [c.alias(dst) for dst, c in columns.items()]
    return df.select(*cols, *([F.col(gps_id).alias("gps_id")] if gps_id else []))


def reorder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``, in order; absent ones become null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def feature_group(df: DataFrame, *groups: str, groups_of: dict = FEATURE_GROUPS, dates_of: dict = FEATURE_DATES) -> DataFrame:
    """Columns of the groups, also of the next bus (suffix ``SB``), and parts of their timestamps such as ``DAY(name)``."""
    wanted = {c for g in groups for c in groups_of[g]}
    dates = {c for g in groups for c in dates_of.get(g, ())}

    def belongs(column: str) -> bool:
        _, part, name = column.partition("(")
        names = dates if part else wanted
        return (name.removesuffix(")") if part else column).removesuffix("SB") in names or column in wanted

    return df.select(*[c for c in df.columns if belongs(c)])


def drop_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def by_position(df: DataFrame, indexes: Sequence[int]) -> DataFrame:
    return df.select(*[df.columns[i] for i in indexes])


def with_row_id(df: DataFrame, order: Sequence[str], slice_by: Column, name: str = "row_id", start: int = 0) -> DataFrame:
    """Dense global row index in the given order."""
    return over_slices(df, [], order, slice_by, **{name: position()}).withColumn(name, F.col(name) - 1 + start)


def with_ping_id(
    df: DataFrame, order: Sequence[str], slice_by: Column, per: Sequence[str] = ("bus",), name: str = "gps_id"
) -> DataFrame:
    """Ping number from 1: per vehicle after sorting, or per file with ``per`` naming the file column."""
    return over_slices(df, list(per), order, slice_by, **{name: position()})


# --- filters -----------------------------------------------------------------------------------


def in_city(df: DataFrame, city: str, column: str = "city") -> DataFrame:
    return df.where(F.col(column).contains(city))


def drop_unlocated(df: DataFrame, cols: Sequence[str] = ("line_code", "latitude", "longitude")) -> DataFrame:
    """Drop pings whose route or position is missing, empty or a dash."""
    keep = [F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "-") for c in cols]
    return df.where(reduce(lambda a, b: a & b, keep))


def has_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.where(F.col(ts).isNotNull() & ~F.trim(F.col(ts).cast("string")).isin("", "-"))


def usable_for_bunching(df: DataFrame, gps: str = "gps_lat", problem: str = "problem") -> DataFrame:
    located = F.col(gps).isNotNull() & (F.col(gps).cast("string") != "-")
    return df.where(located & ~F.col(problem).eqNullSafe(F.lit(TRIP_PROBLEM)))


def in_service(df: DataFrame, line: str = "line_code") -> DataFrame:
    return df.where(~F.col(line).eqNullSafe(F.lit(OUT_OF_SERVICE)))


def headway_over(df: DataFrame, minutes: int, column: str = "headway_min") -> DataFrame:
    return df.where(F.col(column) > minutes)


def where_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.col(column).cast("string").contains(text))


def where_equal(df: DataFrame, **values) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in values.items()]))


def one_class(df: DataFrame, flag: str) -> DataFrame:
    return df.where(~F.col(flag))


# --- sorts and limits --------------------------------------------------------------------------


def sort_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Order by the columns as text."""
    return df.orderBy(*[F.col(c).cast("string") for c in cols])


def sort_stable(df: DataFrame, ts: str, row_id: str) -> DataFrame:
    return df.orderBy(ts, row_id)


def sort_vehicle(df: DataFrame, bus: str = "bus", ts: str = "ts", partitions: int | None = None) -> DataFrame:
    """Files sorted by vehicle and time, a missing time first; ranges split a busy vehicle."""
    when = F.coalesce(F.col(ts).cast("timestamp").cast("long"), F.lit(0))
    keyed = df.withColumn("__when", when)
    ranged = (
        keyed.repartitionByRange(partitions, bus, "__when") if partitions else keyed.repartitionByRange(bus, "__when")
    )
    return ranged.sortWithinPartitions(bus, "__when").drop("__when")


def sort_pair(df: DataFrame, bus: str = "bus", next_bus: str = "bus2", ts: str = "ts") -> DataFrame:
    return df.orderBy(bus, next_bus, ts)


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def lowest(df: DataFrame, column: str, n: int = 20, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(column).asc(), *tie).limit(n)


def top_values(df: DataFrame, keys: Sequence[str], column: str, k: int = 3, name: str = "top") -> DataFrame:
    """The k largest values per key. Counts per distinct value go first, so repeated values of a busy
    key collapse on the map side, and the rank filter prunes again before the shuffle."""
    keys = list(keys)
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    window = Window.partitionBy(*keys).orderBy(F.col(column).desc())
    ranked = counted.withColumn("__r", F.row_number().over(window)).where(F.col("__r") <= k)
    repeated = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col(column).alias("v"), F.least("__n", F.lit(k)).alias("n")))),
            lambda s: F.array_repeat(s["v"], s["n"].cast("int")),
        )
    )
    return ranked.groupBy(*keys).agg(F.slice(F.reverse(repeated), 1, k).alias(name))


def slice_rows(
    df: DataFrame, key: str, order: Sequence[str], slice_by: Column, start: int, stop: int
) -> DataFrame:
    """Rows at positions ``start`` to ``stop - 1`` (from 0) of every key."""
    placed = over_slices(df, [key], order, slice_by, __pos=position())
    return placed.where((F.col("__pos") > start) & (F.col("__pos") <= stop)).drop("__pos")


def ordered_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


# --- set operations ----------------------------------------------------------------------------


def union_days(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_times(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key; an aggregate, so a busy key collapses before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def other_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(excluded)]


def rows_like(df: DataFrame, keys: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows whose id occurs in ``keys``."""
    return df.join(keys.select(on), on, "left_semi")
