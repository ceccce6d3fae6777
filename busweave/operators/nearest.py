"""Exact nearest-point join driven by grid cells.

Rows are grouped into grid cells and points are reduced to distinct places. For every cell that holds
rows, the distance from its centre to the closest place, plus the cell's width, bounds the distance of
any place that can be nearest to any row of the cell; the places within that bound are listed under
the cell. Places are looked up in tiles around the cell, first small, then growing until the bound
lies inside the tiles, so no cell meets all places of its key unless it is that far away.

This work depends on the area covered, not on the number of rows. Rows then join the short list of
their cell: no row is multiplied and, while the lists are small enough to broadcast, none is shuffled.
The small tables are written to the shared scratch folder, so nothing is computed twice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, cell_index, haversine_m
from busweave.session import checkpointed

FIRST_TILE_CELLS = 3
TILE_GROWTH = 8
LIST_ROWS = 64
SMALLEST_CELL, LARGEST_CELL = 0.001, 0.5
#: Places, cells or list entries up to which a side of a join may be broadcast.
SMALL_ROWS = 20_000


def cell_radius_m(size: float) -> float:
    """Upper bound of the distance from a cell's centre to any of its points."""
    return size * METRES_PER_DEGREE * math.sqrt(0.5) * 1.001


def _vector(prefix: str, lat: Column, lon: Column) -> dict[str, Column]:
    """Earth-centred coordinates: chords compare like arcs and cost no trigonometry per pair."""
    lat, lon = F.radians(lat), F.radians(lon)
    return {
        f"{prefix}x": EARTH_RADIUS_M * F.cos(lat) * F.cos(lon),
        f"{prefix}y": EARTH_RADIUS_M * F.cos(lat) * F.sin(lon),
        f"{prefix}z": EARTH_RADIUS_M * F.sin(lat),
    }


def _square(a: str, b: str) -> Column:
    terms = [(F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in "xyz"]
    return terms[0] + terms[1] + terms[2]


def _arc(square: Column) -> Column:
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.sqrt(square) / (2 * EARTH_RADIUS_M), F.lit(1.0)))


def _chord_square(arc: Column) -> Column:
    half = F.least(arc / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2))
    return F.pow(2 * EARTH_RADIUS_M * F.sin(half), F.lit(2.0))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for an equality join with a large table: shuffled unless it has few ``rows``.

    Spark goes by the size of the files. Repeated coordinates compress so well that a table of a few megabytes may
    take hundreds in the driver, which builds what is broadcast.
    """
    return df if rows <= SMALL_ROWS else df.hint("merge")


def cell_size(spots: DataFrame, keys: Sequence[str]) -> float:
    """Cell size in degrees that gives about one place per cell, from each key's extent and count."""
    extent = spots.groupBy(*keys).agg(
        (F.max("__rlat") - F.min("__rlat") + 1e-4).alias("h"),
        (F.max("__rlon") - F.min("__rlon") + 1e-4).alias("w"),
        F.count(F.lit(1)).alias("n"),
    )
    size = extent.agg(F.avg(F.sqrt(F.col("h") * F.col("w") / F.col("n")))).first()[0]
    return min(LARGEST_CELL, max(SMALLEST_CELL, size or LARGEST_CELL))


def cell_options(cells: DataFrame, spots: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Places that can be nearest to a row of each cell."""
    keys = list(keys)
    cell = [*keys, "__li", "__lj"]
    lat, lon = (F.col("__li") + 0.5) * size, (F.col("__lj") + 0.5) * size
    rest = cells.withColumns(_vector("__l", lat, lon))
    width = 2 * cell_radius_m(size)
    # The smaller side counts; each cell is listed under nine tiles.
    n_cells, n_spots = cells.count(), spots.count()
    fewer = min(9 * n_cells, n_spots)
    tile, found = FIRST_TILE_CELLS * size, None
    while True:
        last = tile >= 180
        index = lambda c: F.lit(0).cast("long") if last else F.floor(c / tile)  # noqa: E731,B023
        tiles = [*keys, "__ti", "__tj"]
        # A place near the date line is also listed one turn further, where cells across the line look for it.
        turns = F.array(*[F.lit(float(t)) for t in ([0] if last else [0, -360, 360])])
        b = spots.withColumn("__turn", F.explode(turns)).withColumn("__at", F.col("__rlon") + F.col("__turn"))
        b = b.where((F.col("__turn") == 0) | (F.abs("__at") <= 180 + 2 * tile))
        b = b.withColumns({"__ti": index(F.col("__rlat")), "__tj": index(F.col("__at"))}).drop("__turn", "__at")
        around = [0] if last else [-1, 0, 1]
        nine = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in around for j in around])

        def with_tiles(frame: DataFrame) -> DataFrame:
            listed = frame.withColumn("__t", F.explode(nine))  # noqa: B023
            return listed.withColumns(
                {"__ti": index(lat) + F.col("__t.i"), "__tj": index(lon) + F.col("__t.j")}  # noqa: B023
            ).drop("__t")

        square = _square("__l", "__r")
        met = with_tiles(rest).join(sized(b, fewer), tiles)
        best = met.groupBy(*cell, "__lx", "__ly", "__lz").agg((_arc(F.min(square)) + width).alias("__reach"))
        if not last:
            # Everything this close to the centre lies in the nine tiles around it.
            edge = F.cos(F.radians(F.least(F.abs(lat) + tile, F.lit(90.0))))
            best = best.where(F.col("__reach") <= tile * METRES_PER_DEGREE * edge)
        best = best.withColumn("__limit", _chord_square(F.col("__reach"))).drop("__reach")
        kept = with_tiles(best).join(sized(b, fewer), tiles).where(square <= F.col("__limit"))
        kept = checkpointed(kept.select(*cell, "__rlat", "__rlon", "__rx", "__ry", "__rz", "__r"), "near-options")
        found = kept if found is None else found.unionByName(kept)
        if last:
            return found
        rest = rest.join(sized(kept.select(*cell).distinct(), n_cells), cell, "left_anti")
        if rest.isEmpty():
            return found
        tile *= TILE_GROWTH


def nearest_point(
    left: DataFrame,
    right: DataFrame,
    row_id: Sequence[str],
    keys: Sequence[str],
    prefer: Sequence[str],
    take: Sequence[str],
    left_at: tuple[str, str] = ("lat", "lon"),
    right_at: tuple[str, str] = ("lat", "lon"),
    size: float | None = None,
    distance: str = "distance_m",
    how: str = "left",
) -> DataFrame:
    """``left`` plus ``take`` and the distance (to the millimetre) of its nearest ``right`` point.

    Ties go to the smallest ``prefer``. Rows whose key has no point keep nulls, or drop out
    with ``how="inner"``. Every row of ``left`` is kept as it is, whether or not ``row_id`` tells it apart. ``size`` is the cell size in degrees, by default from the density.
    """
    keys, take, prefer = list(keys), list(take), list(prefer)
    extra = list(dict.fromkeys([*prefer, *take]))
    spots = right.groupBy(*keys, F.col(right_at[0]).alias("__rlat"), F.col(right_at[1]).alias("__rlon")).agg(
        F.min(F.struct(*extra)).alias("__r")
    )
    spots = checkpointed(spots.withColumns(_vector("__r", F.col("__rlat"), F.col("__rlon"))), "spots")
    size = size or cell_size(spots, keys)
    rows = left.withColumns({"__li": cell_index(F.col(left_at[0]), size), "__lj": cell_index(F.col(left_at[1]), size)})
    cell = [*keys, "__li", "__lj"]
    # The cell table is small but every cell means work, so it keeps the full number of partitions.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*cell).dropna().distinct()
    if keys:  # a key without places would be searched for in ever larger tiles
        placed = placed.join(spots.select(*keys).distinct(), keys, "left_semi")
    cells = checkpointed(placed.repartition(parts, *cell), "cells")
    options = cell_options(cells, spots, keys, size)

    # Lists hold at most LIST_ROWS places; a crowded cell gets several, so that no list grows with the data.
    ranked = options.withColumn(
        "__part", F.floor((F.row_number().over(Window.partitionBy(*cell).orderBy("__rlat", "__rlon")) - 1) / LIST_ROWS)
    )
    place = F.struct("__rlat", "__rlon", "__rx", "__ry", "__rz", *[F.col(f"__r.{c}").alias(c) for c in extra])
    lists = checkpointed(ranked.groupBy(*cell, "__part").agg(F.collect_list(place).alias("__places")), "near-lists")

    # Whole millimetres from chords order the few places of the list; no trigonometry of coordinates.
    def scored(p: Column) -> Column:
        parts = [F.col(f"__l{c}") - p[f"__r{c}"] for c in "xyz"]
        arc = _arc(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])
        return F.struct(
            F.floor(arc * 1000 + 0.5).alias("__mm"),
            *[p[c].alias(f"__o_{c}") for c in prefer],
            *[p[c].alias(f"__t_{c}") for c in take],
            p["__rlat"].alias("__rlat"),
            p["__rlon"].alias("__rlon"),
        )

    vectors = _vector("__l", F.col(left_at[0]), F.col(left_at[1]))
    fullest, entries = lists.agg(F.max("__part"), F.sum(F.size("__places"))).first()
    crowded = (fullest or 0) > 0
    # The nearest place depends on cell and coordinates only. Where a cell has several lists, each distinct place of a
    # row is answered once and joined back, so that equal or null ids never matter.
    asked = rows.select(*cell, *left_at).distinct() if crowded else rows
    # Below the join, so that the vectors are computed once per row and not once per place.
    hits = asked.withColumns(vectors).join(sized(lists, entries or 0), cell, "inner" if crowded else how)
    hits = hits.withColumn("__best", F.array_min(F.transform("__places", scored)))
    if crowded:
        best = hits.groupBy(*keys, *left_at).agg(F.min("__best").alias("__best"))
        hits = left.join(best, [*keys, *left_at], how)
    metres = haversine_m(F.col(left_at[0]), F.col(left_at[1]), F.col("__best.__rlat"), F.col("__best.__rlon"))
    return hits.select(*left.columns, *[F.col(f"__best.__t_{c}").alias(c) for c in take], F.round(metres, 3).alias(distance))
