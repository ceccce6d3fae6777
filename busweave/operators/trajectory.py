"""Trajectories of labelled travellers: segments, motion channels and segment features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.functions.geo import bearing_deg, geodesic_m
from busweave.operators.ordered import following, hours, last_seen, over_slices, position, preceding, running_sum

# Limits by mode index (speed in m/s, acceleration in m/s2) and feature thresholds.
SPEED_LIMITS = {0: 7.0, 1: 12.0, 2: 120 / 3.6, 3: 180 / 3.6, 4: 120 / 3.6}
ACCELERATION_LIMITS = {0: 3.0, 1: 3.0, 2: 2.0, 3: 10.0, 4: 3.0}
HEADING_CHANGE_DEG = 19
STOP_SPEED = 3.4
VELOCITY_CHANGE = 0.26

SEGMENT = ["user", "segment"]
DAY_S = 86400


def label_intervals(points: DataFrame, labels: DataFrame, slack_s: int = 1, bucket_s: int = 3600) -> DataFrame:
    """Points inside a labelled interval of their user, a second of slack on both sides. A point in
    two intervals gives two rows. Intervals are listed under the time buckets they touch."""
    bucket = lambda c, by=0: F.floor((F.col(c).cast("long") + by) / bucket_s)
    listed = labels.withColumn("__b", F.explode(F.sequence(bucket("start", -slack_s), bucket("end", slack_s))))
    rows = points.withColumn("__b", bucket("ts"))
    at = F.col("ts").cast("double")
    inside = at.between(F.col("start").cast("double") - slack_s, F.col("end").cast("double") + slack_s)
    return rows.join(listed, ["user", "__b"]).where(inside).drop("__b")


def step_kinematics(points: DataFrame, order: Sequence[str] = ("ts", "point_id"), metric: Callable = geodesic_m) -> DataFrame:
    """Seconds and speed to the next point; no time passed counts as 0.1 s. The last point of a user
    gets three seconds and the speed before it."""
    near = over_slices(
        points, ["user"], list(order), hours("ts", DAY_S), __n=following("lat", "lon", "ts"), __p=preceding("lat", "lon", "ts")
    )
    seconds = lambda a, b: F.col(b).cast("double") - F.col(a).cast("double")
    span = lambda a, b: F.when(seconds(a, b) == 0, 0.1).otherwise(seconds(a, b))
    out = metric(F.col("lat"), F.col("lon"), F.col("__n.lat"), F.col("__n.lon")) / span("ts", "__n.ts")
    back = metric(F.col("__p.lat"), F.col("__p.lon"), F.col("lat"), F.col("lon")) / span("__p.ts", "ts")
    last = F.col("__n").isNull()
    return near.withColumns(
        {"delta_s": F.when(last, 3.0).otherwise(span("ts", "__n.ts")), "speed": F.when(last, back).otherwise(out)}
    ).drop("__n", "__p")


def segment_trips(
    points: DataFrame,
    gap_s: float = 1200,
    max_points: int = 200,
    min_points: int = 10,
    order: Sequence[str] = ("ts", "point_id"),
) -> DataFrame:
    """Cut each user's points where the mode changes, after a pause longer than ``gap_s`` and after
    ``max_points`` points; pieces with fewer than ``min_points`` points drop out.

    Adds ``segment`` and ``seg_pos`` (from 0). Every later window runs on one segment.
    """
    order = list(order)
    cut = hours("ts", DAY_S)
    near = over_slices(points, ["user"], order, cut, __p=preceding("ts", "mode"), __pos=position())
    pause = F.col("ts").cast("double") - F.col("__p.ts").cast("double")
    starts = F.col("__p").isNull() | (F.col("mode") != F.col("__p.mode")) | (pause > gap_s)
    near = near.withColumn("__start", starts).drop("__p")
    runs = over_slices(
        near, ["user"], order, cut,
        __run=running_sum(F.col("__start").cast("int")), __from=last_seen(F.when(F.col("__start"), F.col("__pos"))),
    )
    in_run = F.col("__pos") - F.col("__from")
    cutted = runs.withColumns(
        {"segment": F.concat_ws("-", F.col("__run").cast("string"), F.floor(in_run / max_points).cast("string")), "seg_pos": in_run % max_points}
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*SEGMENT))
    return cutted.withColumn("__n", size).where(F.col("__n") >= min_points).drop("__n", "__pos", "__run", "__from", "__start")


def _by_mode(limits: dict[int, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for item in limits.items() for v in item]), F.col("mode"))


def _in_order():
    return Window.partitionBy(*SEGMENT).orderBy("seg_pos")


def _whole():
    return Window.partitionBy(*SEGMENT)


def speed_filter(
    segments: DataFrame,
    limits: dict[int, float] = SPEED_LIMITS,
    metric: Callable = geodesic_m,
    extra_s: float = 1.0,
    min_steps: int = 10,
) -> DataFrame:
    """Distance, seconds, speed and bearing of each step. Steps over the mode's speed limit drop out,
    then segments with fewer than ``min_steps`` steps; the last point repeats the step before it."""
    w = _in_order()
    nxt = segments.withColumn("__n", F.lead(F.struct("lat", "lon", "ts")).over(w))
    metres = metric(F.col("lat"), F.col("lon"), F.col("__n.lat"), F.col("__n.lon"))
    steps = nxt.withColumns(
        {
            "distance_m": metres,
            "delta_s": F.col("__n.ts").cast("double") - F.col("ts").cast("double") + extra_s,
            "bearing": bearing_deg(F.col("lat"), F.col("lon"), F.col("__n.lat"), F.col("__n.lon")),
            "__last": F.col("__n").isNull(),
        }
    ).drop("__n")
    steps = steps.withColumn("speed", F.col("distance_m") / F.col("delta_s"))
    kept = steps.where(F.col("__last") | ((F.col("speed") <= _by_mode(limits)) & (F.col("speed") >= 0)))
    return _close(kept, ["distance_m", "speed", "bearing"], min_steps)


def _close(steps: DataFrame, copied: Sequence[str], min_steps: int) -> DataFrame:
    """Drop short segments and let the last point repeat the step before it."""
    w = _in_order()
    counted = steps.withColumn("__steps", F.count_if(~F.col("__last")).over(_whole())).where(F.col("__steps") >= min_steps)
    return counted.withColumns(
        {c: F.when(F.col("__last"), F.lag(c).over(w)).otherwise(F.col(c)) for c in copied}
    ).drop("__steps", "__last")


def acceleration_jerk(
    steps: DataFrame, limits: dict[int, float] = ACCELERATION_LIMITS, min_steps: int = 10
) -> DataFrame:
    """Acceleration with the mode's limit, then jerk, each over the steps that are left."""
    w = _in_order()
    marked = steps.withColumns(
        {"__last": F.lead("seg_pos").over(w).isNull(), "acceleration": (F.lead("speed").over(w) - F.col("speed")) / F.col("delta_s")}
    )
    kept = marked.where(F.col("__last") | (F.abs("acceleration") <= _by_mode(limits)))
    done = _close(kept, ["acceleration"], min_steps)
    jerk = done.withColumns(
        {"__last": F.lead("seg_pos").over(w).isNull(), "jerk": (F.lead("acceleration").over(w) - F.col("acceleration")) / F.col("delta_s")}
    )
    return _close(jerk, ["jerk"], min_steps)


def bearing_rate(steps: DataFrame) -> DataFrame:
    """Change of bearing and relative change of speed to the next step (1 from standstill)."""
    w = _in_order()
    turn = F.abs(F.lead("bearing").over(w) - F.col("bearing"))
    change = F.when(F.lead("speed").over(w).isNotNull(), F.when(F.col("speed") == 0, 1.0).otherwise(
        F.try_divide(F.abs(F.lead("speed").over(w) - F.col("speed")), F.col("speed"))
    ))
    marked = steps.withColumns({"__last": F.lead("seg_pos").over(w).isNull(), "bearing_rate": turn, "velocity_change": change})
    return _close(marked, ["bearing_rate", "velocity_change"], 0)


def segment_features(segments: DataFrame) -> DataFrame:
    """Thirteen motion features per segment; segments without distance drop out. A segment has a
    bounded number of points, so its sorted lists are small."""
    top = lambda c, i: F.get(F.sort_array(F.collect_list(c), asc=False), F.lit(i))
    total = F.sum("distance_m")
    rate = lambda cond: F.try_divide(F.count_if(cond).cast("double"), total)
    out = segments.groupBy(*SEGMENT).agg(
        total.alias("distance"),
        F.try_divide(total, F.sum("delta_s")).alias("average_velocity"),
        F.avg("speed").alias("mean_velocity"),
        F.var_pop("speed").alias("velocity_variance"),
        *[top("speed", i).alias(f"max_v{i + 1}") for i in range(3)],
        *[top("acceleration", i).alias(f"max_a{i + 1}") for i in range(3)],
        rate(F.col("bearing_rate") > HEADING_CHANGE_DEG).alias("heading_change_rate"),
        rate(F.col("speed") < STOP_SPEED).alias("stop_rate"),
        rate(F.col("velocity_change") > VELOCITY_CHANGE).alias("velocity_change_rate"),
        F.any_value("mode").alias("label"),
    )
    return out.where("distance > 0")


def pad_channels(segments: DataFrame, channels: Sequence[str], length: int = 200, distance: str = "distance_m") -> DataFrame:
    """Per segment an array of ``length`` rows of channel values, zeros after its last point."""
    point = F.struct("seg_pos", F.array(*[F.col(c).cast("double") for c in channels]).alias("v"))
    listed = segments.groupBy(*SEGMENT).agg(
        F.transform(F.array_sort(F.collect_list(point)), lambda s: s["v"]).alias("__v"),
        F.any_value("mode").alias("label"),
        F.sum(distance).alias("__d"),
    )
    zeros = F.array(*[F.lit(0.0)] * len(channels))
    padded = F.slice(F.concat("__v", F.array_repeat(zeros, F.greatest(F.lit(0), F.lit(length) - F.size("__v")))), 1, length)
    return listed.where("__d > 0").select(*SEGMENT, "label", F.size("__v").alias("points"), padded.alias("channels"))
