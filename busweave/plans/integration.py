"""End-to-end plan: pings and shapes to labelled stop visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busweave.operators import matching as M
from busweave.operators.integrated import integrate, label_visits
from busweave.operators.headway import label_bunching, next_bus_headway
from busweave.operators.interpolate import BETWEEN, interpolate_times
from busweave.session import checkpointed


def match_trips(pings: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched pings and trips. Shared intermediate results are written once to the scratch folder."""
    numbered = checkpointed(M.number_pings(pings), "pings")
    lines = checkpointed(M.shape_lines(shapes), "shape-lines")
    vehicles = checkpointed(M.vehicle_lines(numbered), "vehicle-lines")
    closest = M.closest_per_tag(M.tag_candidates(M.candidate_points(numbered, vehicles, lines)))
    pairs = checkpointed(M.pair_trips(closest), "pairs")
    trips = checkpointed(M.build_trips(pairs, checkpointed(M.choose_shapes(pairs, vehicles, lines), "chosen")), "trips")
    points = M.outlier_points(M.assign_trip(numbered, trips), trips)
    return M.matched_pings(points, shapes, lines), trips


def stop_visits(matched: DataFrame, shapes: DataFrame, stops: DataFrame) -> DataFrame:
    """Estimated passing time of every stop of every trip."""
    latest = M.latest_per_shape_point(matched.where(F.col("shape_seq").isNotNull()))
    rows = M.trips_shapes_stops(latest, shapes, stops)
    timed = interpolate_times(rows, ["day", "bus", "trip_num", "shape"])
    label = F.when(F.col("interpolated"), BETWEEN).otherwise(F.col("problem"))
    return (
        timed.where(F.col("is_stop") & F.col("est_ms").isNotNull())
        .withColumns({"problem": label, "ts": F.timestamp_millis("est_ms")})
        .drop("at_ms", "interpolated", "is_stop", "est_ms")
    )


def labelled_visits(pings: DataFrame, shapes: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop visits with the next bus at the same stop of the day, headway and bunching label."""
    matched, _ = match_trips(pings, shapes)
    visits = checkpointed(stop_visits(checkpointed(matched, "matched"), shapes, stops).join(routes, "shape"), "visits")
    keys = ["day", "route", "shape", "seq"]
    return label_bunching(next_bus_headway(visits, keys, carry=["ts", "bus", "trip_num"]))


def located_visits(matched: DataFrame, shapes: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop visits with the place of their shape point and, where a ping passed it, that ping.

    ``shapes`` has ``street`` and ``cell`` of each point, ``routes`` one row per shape with ``route`` and ``frequency``.
    """
    key = ["day", "bus", "trip_num", "shape", "seq"]
    visits = stop_visits(matched, shapes, stops)
    pings = M.latest_per_shape_point(matched.where(F.col("shape_seq").isNotNull())).select(
        *key[:-1], F.col("shape_seq").alias("seq"), "gps_id", F.col("lat").alias("gps_lat"), F.col("lon").alias("gps_lon"), "distance_m"
    )
    points = shapes.select("shape", "seq", F.col("lat").alias("shape_lat"), F.col("lon").alias("shape_lon"), "street", "cell")
    placed = visits.join(points, ["shape", "seq"]).join(pings, key, "left").join(routes, "shape")
    return placed.withColumns({"stop": F.col("seq"), "visit_id": F.concat_ws("|", *key)})


def integrated_visits(
    pings: DataFrame,
    shapes: DataFrame,
    stops: DataFrame,
    routes: DataFrame,
    stations: DataFrame,
    readings: DataFrame,
    alerts: DataFrame,
    jams: DataFrame,
    scheduled: DataFrame,
    calendar: DataFrame,
) -> DataFrame:
    """All stages: matching, passing times, weather, alerts, jams, defaults, service day, scheduled headway, label."""
    matched, _ = match_trips(pings, shapes)
    visits = checkpointed(located_visits(checkpointed(matched, "matched"), shapes, stops, routes), "visits")
    rows = checkpointed(integrate(visits, stations, readings, alerts, jams), "integrated")
    return label_visits(rows, scheduled, calendar)
