"""Map matching: vehicle days to route shapes, trips and shape points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.functions.geo import haversine_m, is_round_trip, shape_threshold_m
from busweave.functions.times import hhm_bucket
from busweave.operators.nearest import nearest_point
from busweave.operators.ordered import (
    blocks_of,
    hours,
    last_seen,
    over_slices,
    position,
    preceding,
    running_sum,
)
from busweave.operators.shaping import OUT_OF_SERVICE, last_per_key
from busweave.session import checkpointed

# Largest pause inside one group of candidate points, problem labels.
TAG_GAP_S = 600
NO_PROBLEM, NO_SHAPE, TRIP_PROBLEM, OUTLIER_POINT = "NO_PROBLEM", "NO_SHAPE", "TRIP_PROBLEM", "OUTLIER_POINT"

VEHICLE = ["day", "bus"]
POINT_BLOCK = 512


def number_pings(pings: DataFrame, order: Sequence[str] = ("ts", "gps_id")) -> DataFrame:
    """Add ``idx``, the place of a ping in its vehicle's day, from 0."""
    placed = over_slices(pings, VEHICLE, list(order), hours("ts"), idx=position())
    return placed.withColumn("idx", F.col("idx") - 1)


def vehicle_lines(pings: DataFrame) -> DataFrame:
    """One row per vehicle day: pings, greatest gap between neighbours and its route, which is the
    line code of its first ping in service."""
    steps = over_slices(pings, VEHICLE, ["ts", "gps_id"], hours("ts"), __p=preceding("lat", "lon"))
    gap = haversine_m(F.col("__p.lat"), F.col("__p.lon"), F.col("lat"), F.col("lon"))
    serving = F.when(F.col("line_code") != OUT_OF_SERVICE, F.struct("ts", "gps_id"))
    return steps.groupBy(*VEHICLE).agg(
        F.count(F.lit(1)).alias("pings"),
        F.round(F.coalesce(F.max(gap), F.lit(0.0)), 3).alias("greatest_gap_m"),
        F.min_by("line_code", serving).alias("route"),
    )


def shape_lines(shapes: DataFrame, block: int = POINT_BLOCK) -> DataFrame:
    """One row per shape: ends, length, points, greatest gap, end threshold and round-trip flag."""
    steps = over_slices(shapes, ["shape"], ["seq"], blocks_of("seq", block), __p=preceding("lat", "lon"))
    gap = haversine_m(F.col("__p.lat"), F.col("__p.lon"), F.col("lat"), F.col("lon"))
    # By shape and route first: numbers alone are combined without a sort of all points; then few rows are left.
    ends_of = {f"{end}_{c}": by(c, "seq") for end, by in (("start", F.min_by), ("end", F.max_by)) for c in ("lat", "lon")}
    parts = steps.groupBy("shape", "route").agg(
        F.count(F.lit(1)).alias("points"),
        F.max(gap).alias("gap"),
        F.max_by("dist", "seq").alias("dist"),
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        *[v.alias(k) for k, v in ends_of.items()],
    )
    lines = parts.groupBy("shape").agg(
        F.any_value("route").alias("route"),
        F.sum("points").alias("points"),
        F.max_by("dist", "last").alias("total_m"),
        F.round(F.coalesce(F.max("gap"), F.lit(0.0)), 3).alias("greatest_gap_m"),
        F.min_by(F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")), "first").alias("a"),
        F.max_by(F.struct(F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")), "last").alias("b"),
    )
    ends = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return lines.select(
        "shape",
        "route",
        "points",
        "total_m",
        "greatest_gap_m",
        F.col("a.lat").alias("start_lat"),
        F.col("a.lon").alias("start_lon"),
        F.col("b.lat").alias("end_lat"),
        F.col("b.lon").alias("end_lon"),
        shape_threshold_m(F.col("total_m"), F.col("points")).alias("threshold_m"),
        is_round_trip(ends, F.col("greatest_gap_m")).alias("round_trip"),
    )


def lines_with_shapes(gps_lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every vehicle day with every shape of its route; vehicles without shapes keep nulls."""
    named = shapes.select("route", *[F.col(c).alias(f"shape_{c}" if c in gps_lines.columns else c) for c in shapes.columns if c != "route"])
    return gps_lines.join(named, "route", "left")


def candidate_points(pings: DataFrame, gps_lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pings in service within the threshold of a shape's start or, failing that, its end.

    ``side`` says which end was met; ``kind`` is FIRST or LAST, and FIRST for both ends of a round trip.
    """
    routed = pings.where(~F.col("line_code").eqNullSafe(F.lit(OUT_OF_SERVICE))).join(gps_lines.select(*VEHICLE, "route"), VEHICLE)
    pairs = routed.join(
        shapes.select("route", "shape", "start_lat", "start_lon", "end_lat", "end_lon", "threshold_m", "round_trip"), "route"
    )
    to_start = F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("start_lat"), F.col("start_lon")), 3)
    to_end = F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("end_lat"), F.col("end_lon")), 3)
    side = F.when(to_start < F.col("threshold_m"), "START").when(to_end < F.col("threshold_m"), "END")
    found = pairs.withColumn("side", side).where(F.col("side").isNotNull())
    first = (F.col("side") == "START") | F.col("round_trip")
    return found.select(
        *VEHICLE,
        "shape",
        "idx",
        "ts",
        "side",
        F.when(first, "FIRST").otherwise("LAST").alias("kind"),
        F.when(first, to_start).otherwise(to_end).alias("end_m"),
    )


def tag_candidates(candidates: DataFrame, gap_s: int = TAG_GAP_S, block: int = POINT_BLOCK) -> DataFrame:
    """Add ``tag``: a candidate more than ``gap_s`` after the one before it starts a break; a break
    takes the ten-minute tag of its ping unless the last break on the same side was the ping just
    before. Other candidates keep the running tag."""
    keys = [*VEHICLE, "shape"]
    cut = blocks_of("idx", block)
    # Each step reads its input twice, so the (few) candidates are written between steps.
    candidates = checkpointed(candidates, "candidates")
    broken = over_slices(candidates, keys, ["idx"], cut, __p=preceding("ts")).withColumn(
        "__break",
        F.col("__p").isNull() | (F.col("ts").cast("double") - F.col("__p.ts").cast("double") > gap_s),
    )
    broken = checkpointed(broken, "breaks")
    on = lambda side: F.when(F.col("__break") & (F.col("side") == side), F.col("idx"))
    last = over_slices(
        broken, keys, ["idx"], cut, __ls=last_seen(on("START"), inclusive=False), __le=last_seen(on("END"), inclusive=False)
    )
    last = checkpointed(last, "last-breaks")
    previous = F.coalesce(F.when(F.col("side") == "START", F.col("__ls")).otherwise(F.col("__le")), F.lit(-2))
    renewed = F.when(F.col("__break") & (F.col("idx") > previous + 1), hhm_bucket(F.col("ts")))
    return over_slices(last, keys, ["idx"], cut, tag=last_seen(renewed)).drop("__p", "__break", "__ls", "__le")


def closest_per_tag(candidates: DataFrame, block: int = POINT_BLOCK) -> DataFrame:
    """Candidate closest to its end of the shape in every run of equal tags of one kind."""
    keys = [*VEHICLE, "shape", "kind"]
    cut = blocks_of("idx", block)
    before = over_slices(checkpointed(candidates, "tagged"), keys, ["idx"], cut, __p=preceding("tag"))
    before = checkpointed(before, "tag-runs")
    starts = F.when(F.col("__p").isNull() | (F.col("__p.tag") != F.col("tag")), 1).otherwise(0)
    runs = over_slices(before, keys, ["idx"], cut, run=running_sum(starts))
    return runs.groupBy(*keys, "run").agg(
        F.min_by("idx", F.struct("end_m", "idx")).alias("idx"), F.any_value("tag").alias("tag")
    )


_TRIPS = "array<struct<first_idx:bigint,last_idx:bigint,broken:boolean>>"


def _trip(first: Column, last: Column, broken: Column) -> Column:
    return F.struct(first.alias("first_idx"), last.alias("last_idx"), broken.alias("broken"))


def _alternating(ends: Column, last_start: Column, last_end: Column) -> Column:
    """Trips between start and end points, one after the other, as a fold over ``ends`` (structs ``idx, start``).

    ``ends`` are sorted, an end point before a start point of the same place. The first start point opens a trip and
    the next end point after it closes it. Start points inside a trip split it there, the parts before them being
    broken; inside the trip that takes the last end point they change nothing. An end point that finds no open trip
    marks a broken stretch from the last closed one if a start point comes later and one came before.
    """
    nothing = F.array().cast(_TRIPS)
    zero = F.struct(
        F.lit(0).cast("long").alias("closed"),
        F.lit(None).cast("long").alias("open"),
        F.array().cast("array<bigint>").alias("inner"),
        F.lit(False).alias("seen"),
        nothing.alias("trips"),
    )

    def step(state: Column, point: Column) -> Column:
        at, trips, opened, closed, inner = point["idx"], state["trips"], state["open"], state["closed"], state["inner"]
        # A start point where the last trip ended splits it.
        meets = state["seen"] & opened.isNull() & (at <= closed)
        tail = F.try_element_at(trips, F.lit(-1))
        cut = F.concat(
            F.slice(trips, 1, F.greatest(F.size(trips) - 1, F.lit(0))),
            F.array(_trip(tail["first_idx"], at, F.lit(True)), _trip(at + 1, tail["last_idx"], F.lit(False))),
        )
        after_start = F.when(meets & (F.size(trips) > 0) & (closed < last_end), cut).otherwise(trips)
        opens = opened.isNull() & ~meets
        starts = F.concat(F.array(opened), F.transform(inner, lambda x: x + 1))
        parts = F.zip_with(starts, F.concat(inner, F.array(at)), lambda a, b: _trip(a, b, b != at))
        closing = F.when(at == last_end, F.array(_trip(opened, at, F.lit(False)))).otherwise(parts)
        stray = F.when(state["seen"] & (at <= last_start), F.array(_trip(closed, at, F.lit(True)))).otherwise(nothing)
        after_end = F.concat(trips, F.when(opened.isNotNull(), closing).otherwise(stray))
        start = point["start"]
        return F.struct(
            F.when(~start & opened.isNotNull(), at).otherwise(closed).alias("closed"),
            F.when(start, F.when(opens, at).otherwise(opened)).alias("open"),
            F.when(start & opened.isNotNull(), F.concat(inner, F.array(at))).when(start, inner).otherwise(zero["inner"]).alias("inner"),
            (state["seen"] | start).alias("seen"),
            F.when(start, after_start).otherwise(after_end).alias("trips"),
        )

    return F.aggregate(ends, zero, step, lambda state: state["trips"])


def _consecutive(points: Column) -> Column:
    """Only one kind of end: every trip runs from one point to the next, and the next begins behind it."""
    n = F.size(points)
    trip = lambda i: _trip(F.element_at(points, i) + F.when(i == 1, 0).otherwise(1), F.element_at(points, i + 1), F.lit(False))
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), trip)).otherwise(F.array().cast(_TRIPS))


def pair_trips(closest: DataFrame) -> DataFrame:
    """Pair start and end points into trips, per vehicle day and shape: ``trip_num`` from 1, ``first_idx``,
    ``last_idx``, ``broken``.

    The pairing is sequential and runs as a fold over the sorted points of a group. A group has one row per tag run,
    and runs are more than ten minutes apart: at most 288 rows, whatever the ping rate.
    """
    start = F.col("kind") == "FIRST"
    keys = ["day", F.col("bus").cast("string").alias("bus"), F.col("shape").cast("long").alias("shape")]
    groups = closest.select(*keys, F.col("idx").cast("long").alias("idx"), start.alias("start")).groupBy("day", "bus", "shape").agg(
        F.array_sort(F.collect_list(F.struct("idx", "start"))).alias("ends"),
        F.max(F.when(F.col("start"), F.col("idx"))).alias("last_start"),
        F.max(F.when(~F.col("start"), F.col("idx"))).alias("last_end"),
    )
    both = F.col("last_start").isNotNull() & F.col("last_end").isNotNull()
    trips = F.when(both, _alternating(F.col("ends"), F.col("last_start"), F.col("last_end"))).otherwise(
        _consecutive(F.transform("ends", lambda e: e["idx"]))
    )
    listed = groups.select("day", "bus", "shape", F.posexplode(trips).alias("n", "trip"))
    return listed.select("day", "bus", "shape", (F.col("n") + 1).alias("trip_num"), "trip.*")


def complementary_shape(shapes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per vehicle day, the first other shape of its route that runs the chosen one backwards:
    ``day, bus, shape, partner`` where start meets end within the partner's greatest gap."""
    a = candidates.select(*VEHICLE, "route", F.col("shape").alias("chosen"))
    ends = ["start_lat", "start_lon", "end_lat", "end_lon"]
    mine = shapes.select(F.col("shape").alias("chosen"), *[F.col(c).alias(f"__{c}") for c in ends])
    per_shape = (
        mine.join(shapes.select(F.col("shape").alias("chosen"), "route"), "chosen")
        .join(shapes.select("route", "shape", "greatest_gap_m", *ends), "route")
        .where(
            (haversine_m(F.col("__start_lat"), F.col("__start_lon"), F.col("end_lat"), F.col("end_lon")) < F.col("greatest_gap_m"))
            & (haversine_m(F.col("__end_lat"), F.col("__end_lon"), F.col("start_lat"), F.col("start_lon")) < F.col("greatest_gap_m"))
        )
        .select("chosen", F.col("shape").alias("partner"))
    )
    return a.join(per_shape, "chosen").select(*VEHICLE, F.col("chosen").alias("shape"), "partner")


def choose_shapes(pairs: DataFrame, gps_lines: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapes a vehicle really drove on a day, with ``rank`` 1, 2, …

    Routes with more than two shapes and no round trip: of the two shapes that start earliest (and
    have two trips or more) the one whose first trip is longer, then the shape running backwards.
    Routes with a round trip and several shapes: the shape that starts first. Otherwise all.
    """
    of_route = shapes.groupBy("route").agg(F.count(F.lit(1)).alias("n_shapes"), F.max("round_trip").alias("any_round"))
    lines = gps_lines.select("day", F.col("bus").cast("string").alias("bus"), "route").join(of_route, "route")
    heads = pairs.groupBy("day", "bus", "shape").agg(
        F.count(F.lit(1)).alias("trips"),
        F.min_by(F.struct("first_idx", "last_idx", "broken"), "trip_num").alias("h"),
    )
    seen = heads.join(lines, VEHICLE).select(
        *VEHICLE, "route", "shape", "trips", "n_shapes", "any_round",
        F.col("h.first_idx").alias("first"), (F.col("h.last_idx") - F.col("h.first_idx")).alias("span"),
    )
    rule = F.when(~F.col("any_round") & (F.col("n_shapes") > 2), "OPPOSITE").when(
        F.col("any_round") & (F.col("n_shapes") > 1), "FIRST"
    ).otherwise("ALL")
    seen = seen.withColumn("rule", rule)
    # Windows here see one row per shape of a route, a handful.
    early = Window.partitionBy(*VEHICLE).orderBy("first", "shape")
    opposite = (
        seen.where("rule = 'OPPOSITE' AND trips > 1")
        .withColumns({"place": F.row_number().over(early), "others": F.count(F.lit(1)).over(Window.partitionBy(*VEHICLE))})
        .where("place <= 2 AND others >= 2")
    )
    winner = F.max_by("shape", F.struct((F.when(F.col("place") == 1, F.col("span")).otherwise(F.col("span") + 0.5)), "place"))
    chosen = opposite.groupBy(*VEHICLE, "route").agg(winner.alias("shape"))
    partner = (
        complementary_shape(shapes, chosen)
        .join(seen.select(*VEHICLE, F.col("shape").alias("partner"), "first"), [*VEHICLE, "partner"], "left")
        .groupBy(*VEHICLE)
        .agg(F.min_by("partner", F.struct(F.col("first").isNotNull(), "first", "partner")).alias("shape"))
    )
    decided = chosen.select(*VEHICLE)
    fallback = seen.where("rule = 'OPPOSITE'").join(decided, VEHICLE, "left_anti")
    first_rule = seen.where("rule = 'FIRST'").withColumn(
        "rank", F.row_number().over(Window.partitionBy(*VEHICLE).orderBy("first", F.col("span").desc(), "shape"))
    ).where("rank = 1")
    every = fallback.unionByName(seen.where("rule = 'ALL'")).withColumn("rank", F.row_number().over(early))
    out = [*VEHICLE, "shape", F.col("rank").cast("int").alias("rank")]
    return (
        chosen.withColumn("rank", F.lit(1)).select(*out)
        .unionByName(partner.withColumn("rank", F.lit(2)).select(*out))
        .unionByName(first_rule.select(*out))
        .unionByName(every.select(*out))
    )


def _put(values: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(key, value))


def _clipped(trips: Column) -> Column:
    """Trips that remain of ``trips``, sorted structs, as a fold; ``starts`` and ``ends`` hold, of a trip number, the
    first start and the last end so far."""
    known = "map<int,bigint>"
    kept = "array<struct<shape:bigint,trip_num:int,first_idx:bigint,last_idx:bigint,broken:boolean>>"
    zero = F.struct(
        F.create_map().cast(known).alias("starts"), F.create_map().cast(known).alias("ends"), F.array().cast(kept).alias("trips")
    )

    def step(state: Column, trip: Column) -> Column:
        starts, ends, n = state["starts"], state["ends"], trip["trip_num"]
        own = F.try_element_at(ends, n)
        # Unknown bounds are null, which neither greatest nor least looks at.
        first = F.greatest(trip["first_idx"], F.try_element_at(ends, n - 1) + 1, own + 1)
        last = F.least(trip["last_idx"], F.try_element_at(starts, n + 1))
        remains = first < last
        # The gap behind an earlier trip of the number counts as taken.
        taken = F.when(remains, last).when(own.isNotNull() & (first > own + 1), first)
        row = F.struct(trip["shape"].alias("shape"), n.alias("trip_num"), first.alias("first_idx"), last.alias("last_idx"), trip["broken"].alias("broken"))
        return F.struct(
            F.when(remains & F.try_element_at(starts, n).isNull(), _put(starts, n, first)).otherwise(starts).alias("starts"),
            F.when(taken.isNotNull(), _put(ends, n, taken)).otherwise(ends).alias("ends"),
            F.when(remains, F.concat(state["trips"], F.array(row))).otherwise(state["trips"]).alias("trips"),
        )

    return F.aggregate(trips, zero, step, lambda state: state["trips"])


def build_trips(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Trips of the chosen shapes, clipped so that they do not overlap their neighbours.

    Shapes are laid down in the order of their rank. A trip starts after the trips of the number before it and after
    those of its own number, and ends no later than the first trip of the next number starts; all three as already
    clipped. This is sequential, so it runs as a fold over the few trips of a vehicle day.
    """
    rows = pairs.join(chosen, [*VEHICLE, "shape"])
    trip = F.struct("rank", "shape", "trip_num", "first_idx", "last_idx", "broken")
    days = rows.groupBy(*VEHICLE).agg(F.array_sort(F.collect_list(trip)).alias("trips"))
    clipped = days.select(*VEHICLE, F.inline(_clipped(F.col("trips"))))
    return clipped.select(
        *VEHICLE, "shape", "trip_num", "first_idx", "last_idx",
        F.when(F.col("broken"), TRIP_PROBLEM).otherwise(NO_PROBLEM).alias("problem"),
    )


def assign_trip(points: DataFrame, trips: DataFrame, block: int = 256) -> DataFrame:
    """Trip of every point, null where none covers it; the earliest trip wins a shared point.

    Trips are listed under the index blocks they touch: the range join becomes an equality join.
    """
    listed = trips.withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col("first_idx") / block), F.floor(F.col("last_idx") / block)))
    ).withColumnRenamed("bus", "__bus")
    rows = points.withColumns({"__b": F.floor(F.col("idx") / block), "__bus": F.col("bus").cast("string")})
    hits = (
        rows.select("day", "__bus", "__b", "idx")
        .join(listed, ["day", "__bus", "__b"])
        .where(F.col("idx").between(F.col("first_idx"), F.col("last_idx")))
        .groupBy("day", "__bus", "idx")
        .agg(F.min(F.struct("trip_num", "first_idx", "shape", "problem")).alias("__t"))
    )
    return rows.join(hits, ["day", "__bus", "idx"], "left").select(
        *points.columns,
        F.col("__t.trip_num").alias("trip_num"),
        F.col("__t.shape").alias("trip_shape"),
        F.col("__t.problem").alias("trip_problem"),
    )


def outlier_points(assigned: DataFrame, trips: DataFrame, block: int = POINT_BLOCK) -> DataFrame:
    """Give points outside all trips the number of the trip before them (the first trip if none) and
    the outlier label; vehicles without any trip get ``NO_SHAPE``."""
    matched = trips.select("day", F.col("bus").alias("__bus")).distinct().withColumn("__any", F.lit(True))
    carried = over_slices(assigned, VEHICLE, ["idx"], blocks_of("idx", block), __n=last_seen(F.col("trip_num")))
    flagged = carried.withColumn("__bus", F.col("bus").cast("string")).join(matched, ["day", "__bus"], "left")
    missing = F.when(F.col("__any"), OUTLIER_POINT).otherwise(NO_SHAPE)
    return flagged.withColumns(
        {
            "trip_problem": F.coalesce("trip_problem", missing),
            "trip_num": F.coalesce("trip_num", F.when(F.col("__any"), F.coalesce("__n", F.lit(1)))),
        }
    ).drop("__n", "__any", "__bus")


def nearest_shape_point(
    pings: DataFrame, shapes: DataFrame, row_id: Sequence[str], tie: str = "last"
) -> DataFrame:
    """Nearest point of the ping's shape: ``shape_seq``, its place and ``distance_m``."""
    sign = -1 if tie == "last" else 1
    points = shapes.select(
        "shape", "lat", "lon", (F.col("seq") * sign).alias("__tie"), F.col("seq").alias("shape_seq"),
        F.col("lat").alias("shape_lat"), F.col("lon").alias("shape_lon"), F.col("dist").alias("shape_dist"),
    )
    return nearest_point(
        pings, points, row_id, ["shape"], ["__tie"], ["shape_seq", "shape_lat", "shape_lon", "shape_dist"]
    )


def matched_pings(points: DataFrame, shapes: DataFrame, lines: DataFrame, row_id: Sequence[str] = ("day", "bus", "idx")) -> DataFrame:
    """Pings with trip, nearest shape point and final problem label."""
    located = nearest_shape_point(points.withColumnRenamed("trip_shape", "shape"), shapes, row_id)
    limits = lines.select("shape", "threshold_m")
    label = F.when(F.col("trip_problem") != NO_PROBLEM, F.col("trip_problem")).when(
        F.col("distance_m") > F.col("threshold_m"), OUTLIER_POINT
    ).otherwise(NO_PROBLEM)
    return located.join(limits, "shape", "left").withColumn("problem", label).drop("trip_problem")


def latest_per_shape_point(matches: DataFrame, keys: Sequence[str] = ("day", "bus", "trip_num", "shape", "shape_seq"), ts: str = "ts", tie: str = "gps_id") -> DataFrame:
    """The last ping at each shape point of a trip."""
    return last_per_key(matches, list(keys), [ts, tie])


def trips_shapes_stops(latest: DataFrame, shapes: DataFrame, stops: DataFrame) -> DataFrame:
    """Matched points of each trip plus the stops of its shape, ready for interpolation.

    Only matched points and stops are emitted: other shape points cannot change a stop's time.
    """
    trip = ["day", "bus", "trip_num", "shape"]
    seen = latest.select(*trip, F.col("shape_seq").alias("seq"), F.col("shape_dist").alias("dist"), F.unix_millis("ts").alias("at_ms"), "problem", F.lit(False).alias("is_stop"))
    stop_points = stops.join(shapes.select("shape", "seq", "dist"), ["shape", "seq"])
    wanted = latest.select(*trip).distinct().join(stop_points, "shape").select(
        *trip, "seq", "dist", F.lit(None).cast("long").alias("at_ms"), F.lit(None).cast("string").alias("problem"), F.lit(True).alias("is_stop")
    )
    both = seen.unionByName(wanted)
    return both.groupBy(*trip, "seq").agg(
        F.max("dist").alias("dist"), F.max("at_ms").alias("at_ms"), F.max("problem").alias("problem"), F.max("is_stop").alias("is_stop")
    )
