"""Bunching between vehicles that pass close to each other, and its shares."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.functions.geo import METRES_PER_DEGREE, haversine_m
from busweave.functions.times import hhm_bucket

# Largest distance and time gap between bunched vehicles.
DISTANCE_M = 100
GAP_S = 5


def bunching_pairs(
    df: DataFrame,
    row_id: str = "id",
    keys: Sequence[str] = ("date", "route", "shape"),
    ts: str = "ts",
    bus: str = "bus",
    distance_m: float = DISTANCE_M,
    gap_s: float = GAP_S,
) -> DataFrame:
    """Per ping and other bus of the same keys and ten-minute tag, the ping nearest in time, kept
    when it is less than ``gap_s`` and ``distance_m`` away.

    A ping can only be nearest to pings that no neighbour of it, the pings of its bus just before and after, is nearer
    to. Neighbours tell that ahead of any pairing, so only pings that are also close in place are paired: rows of
    equal keys, tag, date, stretch of time and place cell, with rows near a border listed on both sides of it.
    """
    keys = list(keys)
    if gap_s > 80_000:
        raise ValueError("gap_s must be less than a day, for rows are paired within a date")
    tagged = [*keys, "__date", "tag"]
    rows = df.select(
        *keys,
        F.col(row_id).alias("id"),
        F.col(bus).alias("bus"),
        F.col(ts).cast("double").alias("at"),
        "lat",
        "lon",
        hhm_bucket(F.col(ts)).alias("tag"),
        F.to_date(ts).alias("__date"),
    )
    chain = Window.partitionBy(*tagged, "bus").orderBy("at")
    ping = F.struct("id", "lat", "lon")
    single = rows.dropna(subset=["at", "bus"]).groupBy(*tagged, "bus", "at").agg(F.min(ping).alias("ping"))
    near = F.struct("at", "ping")
    single = single.withColumns({"before": F.lag(near).over(chain), "after": F.lead(near).over(chain)})

    # A tag lasts ten minutes; shorter gaps cut it into stretches.
    stretch = 2 * gap_s
    times = lambda reach: F.floor((F.col("at") + reach) / stretch) if stretch < 600 else F.lit(0)
    cell = [*tagged, "__t", "__band", "__cell"]
    a = rows.withColumns({"__t": times(0), "__band": _band(F.col("lat"), distance_m)})
    a = a.withColumn("__cell", _cell(F.col("lon"), F.col("__band"), distance_m, 0)).select(*cell, *[F.col(c).alias(f"a_{c}") for c in ("id", "bus", "at", "lat", "lon")])
    band = [_band(F.col("ping.lat") + sign * _degrees(distance_m), distance_m) for sign in (-1, 1)]
    b = single.where("ping.lat IS NOT NULL AND ping.lon IS NOT NULL").withColumn("__band", F.explode(F.array_distinct(F.array(*band))))
    b = b.withColumn("__cell", F.explode(F.array_distinct(F.array(*[_cell(F.col("ping.lon"), F.col("__band"), distance_m, sign) for sign in (-1, 1)]))))
    b = b.withColumn("__t", F.explode(F.array_distinct(F.array(times(-gap_s), times(gap_s)))))
    b = b.select(*cell, F.col("bus").alias("b_bus"), F.col("at").alias("b_at"), "ping", "before", "after")
    scored = lambda at, ping: F.struct(F.abs(F.col("a_at") - at).alias("gap"), ping.alias("ping"))
    own = scored(F.col("b_at"), F.col("ping"))
    nearest = F.lit(True)
    for c in ("before", "after"):
        nearest = nearest & (F.col(c).isNull() | (own <= scored(F.col(f"{c}.at"), F.col(f"{c}.ping"))))
    metres = F.round(haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("ping.lat"), F.col("ping.lon")), 3)
    gap = F.abs(F.col("a_at") - F.col("b_at"))
    met = a.join(b, cell).where((F.col("a_bus") != F.col("b_bus")) & (gap < gap_s) & nearest & (metres < distance_m))
    best = met.groupBy("a_id", "b_bus").agg(F.min(F.struct(gap.alias("gap"), F.col("ping.id").alias("id"), metres.alias("metres"))).alias("b"))
    return best.select(
        F.col("a_id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("b.metres").alias("distance_m"), F.col("b.gap").alias("gap_s")
    )


def _degrees(distance_m: float) -> float:
    """Degrees of latitude that two places within the distance differ by at most."""
    return (distance_m + 0.01) / METRES_PER_DEGREE * 1.0001


def _band(lat: Column, distance_m: float) -> Column:
    return F.floor(lat / (2 * _degrees(distance_m)))


def _cell(lon: Column, band: Column, distance_m: float, side: int) -> Column:
    """Cell of a longitude, moved by the reach of ``distance_m`` to a ``side``, on the circle of a band of latitude.

    Cells are twice as wide as two places within the distance, one of them in the band, can differ; around a pole one
    cell is the whole circle.
    """
    step = _degrees(distance_m)
    outer = F.greatest(F.abs(band * 2 * step - step), F.abs((band * 2 + 3) * step))
    narrow = F.cos(F.radians(F.least(outer, F.lit(90.0))))
    half = F.lit(math.sin(math.radians(step) / 2)) / narrow
    reach = F.when(half < 0.5, 2 * F.degrees(F.asin(F.least(half, F.lit(1.0)))))
    cells = F.greatest(F.floor(360 / (2 * reach)), F.lit(1))
    at = F.floor((lon + side * reach) * cells / 360)
    return F.when(lon.isNotNull(), F.coalesce(F.pmod(at, cells), F.lit(0)))


def bunching_lists(df: DataFrame, pairs: DataFrame, row_id: str = "id") -> DataFrame:
    """Text list ``i-j-k-`` of the ids each row is bunched with, itself included; empty if none."""
    both = pairs.select(F.col("id_a").alias("i"), F.col("id_b").alias("j")).unionByName(
        pairs.select(F.col("id_b").alias("i"), F.col("id_a").alias("j"))
    )
    lists = both.groupBy("i").agg(F.collect_set("j").alias("js"))
    text = F.concat(F.concat_ws("-", F.transform(F.array_sort(F.array_union(F.array(F.col("i")), "js")), lambda v: v.cast("string"))), F.lit("-"))
    named = lists.select(F.col("i").alias("__i"), text.alias("bunched_with"))
    return (
        df.join(named, F.col(row_id) == F.col("__i"), "left")
        .drop("__i")
        .withColumn("bunched_with", F.coalesce("bunched_with", F.lit("")))
    )


def bunching_share(
    df: DataFrame, keys: Sequence[str], flag: str = "bunched", trip: Sequence[str] = ("date", "route", "bus", "trip")
) -> DataFrame:
    """Trips with and without a hit per group, with their share of the group's trips.

    ``hit_share`` is the share of trips with a hit, on both rows of a group.
    """
    keys = list(keys)
    trips = df.groupBy(*dict.fromkeys([*keys, *trip])).agg(F.max(flag).alias("has_bunching"))
    counts = trips.groupBy(*keys, "has_bunching").agg(F.count(F.lit(1)).alias("trips"))
    share = F.col("trips") / F.sum("trips").over(Window.partitionBy(*keys))
    return counts.withColumn("share", share).withColumn(
        "hit_share", F.when(F.col("has_bunching"), F.col("share")).otherwise(1 - F.col("share"))
    )


def routes_with_bunching(df: DataFrame, flag: str = "bunched", cols: Sequence[str] = ("route", "bus")) -> DataFrame:
    """Distinct values of each column, and how many of them have a hit."""
    longs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p"),
        F.col(flag).alias("hit"),
    ).select("p.column", "p.v", "hit")
    per_value = longs.groupBy("column", "v").agg(F.max("hit").alias("hit"))
    return per_value.groupBy("column").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("with_bunching"))
