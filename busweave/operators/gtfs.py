"""Timetable enrichment and scheduled frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.functions.times import seconds_mod_day
from busweave.operators.nearest import nearest_point
from busweave.operators.ordered import over_slices, preceding
from busweave.operators.shaping import first_per_key

MISSING = "-"


def route_headway_medians(
    stop_times: DataFrame,
    keys: Sequence[str] = ("route", "service_id", "stop_id"),
    route: str = "route",
    arrival: str = "arrival_s",
    tie: Sequence[str] = (),
    slice_s: int = 900,
) -> DataFrame:
    """Median scheduled gap per route in seconds, and the median of those medians.

    Gaps that touch a time at or past 24:00 are skipped. A gap is a whole number of seconds below a
    day, so the exact percentile holds at most 86 400 distinct values per route.
    """
    keys = list(keys)
    rows = stop_times.select(*keys, arrival, *tie)
    gaps = over_slices(rows, keys, [arrival, *tie], F.floor(F.col(arrival) / slice_s), __prev=preceding(arrival))
    before = F.col(f"__prev.{arrival}")
    usable = gaps.where((F.col(arrival) < 86400) & (before < 86400)).select(
        route, seconds_mod_day(before, F.col(arrival)).alias("gap")
    )
    medians = usable.groupBy(route).agg(F.percentile("gap", 0.5).alias("median_s"))
    city = medians.agg(F.percentile("median_s", 0.5).alias("city_median_s"))
    return _with_constant(medians, city)


def _with_constant(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame through an equality on a constant."""
    return df.withColumn("__one", F.lit(1)).join(one_row.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")


def route_frequency(routes: DataFrame, medians: DataFrame, route: str = "route") -> DataFrame:
    """``high`` where the route's median gap is at most the city's, else (or without data) ``low``."""
    label = F.when(F.col("median_s") <= F.col("city_median_s"), "high").otherwise("low")
    return routes.join(medians, route, "left").withColumn("frequency", label).drop("median_s", "city_median_s")


def stop_times_with_shapes(gtfs: dict[str, DataFrame]) -> DataFrame:
    """Stop events with service, position, route, shape and nearest shape point.

    The nearest point is found once per distinct (stop, shape), not per stop event.
    """
    trips = first_per_key(gtfs["trips"], ["trip_id"], ["file_order"])
    stops = first_per_key(gtfs["stops"], ["stop_id"], ["file_order"])
    routes = first_per_key(gtfs["routes"], ["route_id"], ["file_order"])
    events = (
        gtfs["stop_times"]
        .join(trips.select("trip_id", "route_id", "service_id", "shape_id"), "trip_id")
        .join(stops.select("stop_id", "lat", "lon"), "stop_id")
        .join(routes.select("route_id", "route_code"), "route_id", "left")
        .withColumn("route", F.coalesce("route_code", F.lit(MISSING)))
    )
    on_shape = nearest_for_stop(events.select("stop_id", "shape_id", "lat", "lon").distinct(), gtfs["shapes"])
    return events.join(on_shape.select("stop_id", "shape_id", "shape_seq"), ["stop_id", "shape_id"]).select(
        "service_id", "arrival", "departure", "stop_id", "stop_seq", "lat", "lon", "route", "shape_id", "shape_seq", "trip_id"
    )


def nearest_for_stop(stops: DataFrame, shapes: DataFrame) -> DataFrame:
    """Nearest shape point per (stop, shape); the first point wins ties."""
    points = shapes.select("shape_id", F.col("seq").alias("shape_seq"), "lat", "lon")
    return nearest_point(stops, points, ["stop_id", "shape_id"], ["shape_id"], ["shape_seq"], ["shape_seq"])


def shapes_with_routes(gtfs: dict[str, DataFrame], route_label: Column | None = None, unit_km: bool = False) -> DataFrame:
    """Shape points with route and frequency, a dash where unknown; kilometres become metres."""
    trips = first_per_key(gtfs["trips"].select("shape_id", "route_id", "file_order"), ["shape_id"], ["file_order"])
    routes = first_per_key(gtfs["routes"], ["route_id"], ["file_order"])
    label = route_label if route_label is not None else F.col("route_code")
    joined = gtfs["shapes"].join(trips.drop("file_order"), "shape_id", "left").join(routes.drop("file_order"), "route_id", "left")
    return joined.select(
        F.coalesce(label, F.lit(MISSING)).alias("route"),
        "shape_id",
        "lat",
        "lon",
        "seq",
        (F.col("dist") * 1000 if unit_km else F.col("dist")).alias("dist"),
        F.coalesce("frequency", F.lit(MISSING)).alias("frequency"),
    )
