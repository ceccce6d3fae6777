"""Queries: nearest points, weather, traffic reports, interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.operators import enrich as E
from busweave.operators import interpolate as I
from busweave.operators.nearest import nearest_point
from busweave.operators.streets import containing_pairs
from busweave.plans import bindings as B
from busweave.plans.registry import query
from busweave.session import checkpointed

_D = f"round({B.sql_haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')}, 3)"


@query(
    "j03_nearest_shape_point",
    B.sql(
        B.PINGS,
        B.SHAPES,
        body=f"""SELECT p.event_id, arg_min(h.seq, ({_D}, -h.seq)) AS seq, min({_D}) AS distance_m
        FROM pings p JOIN shapes h ON h.shape = p.shape GROUP BY 1""",
    ),
)
def _(t):
    points = B.shapes(t).withColumn("neg", -F.col("seq"))
    out = nearest_point(
        B.pings(t).select("event_id", "shape", "lat", "lon"), points, ["event_id"], ["shape"], ["neg"], ["seq"], how="inner"
    )
    return out.select("event_id", "seq", "distance_m")


_ST = f"round({B.sql_haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')}, 3)"
_NEAREST = f"""placed AS (SELECT p.event_id, p.ts, p.s, arg_min(h.station, ({_ST}, h.station)) AS station, min({_ST}) AS station_m
  FROM pings p, stations h GROUP BY 1, 2, 3)"""


@query("j07_nearest_station", B.sql(B.PINGS, B.STATIONS, _NEAREST, body="SELECT event_id, station, station_m FROM placed"))
def _(t):
    out = E.nearest_station(B.pings(t).select("event_id", "lat", "lon"), B.stations(t), ["event_id"])
    return out.select("event_id", "station", "station_m")


_ASOF = """hrs AS (SELECT DISTINCT station, CAST(ts AS DATE) AS d, hour(ts) AS h FROM readings),
want AS (SELECT p.event_id, p.station, p.ts, p.s, coalesce(min(h.h) FILTER (h.h >= hour(p.ts)), max(h.h) FILTER (h.h < hour(p.ts))) AS h
  FROM placed p LEFT JOIN hrs h ON h.station = p.station AND h.d = CAST(p.ts AS DATE) GROUP BY 1, 2, 3, 4),
got AS (SELECT w.event_id, arg_min(r.precipitation, (abs(CAST(trunc((r.s - w.s) / 60.0) AS BIGINT)), r.ts)) AS precipitation,
  arg_min(r.s, (abs(CAST(trunc((r.s - w.s) / 60.0) AS BIGINT)), r.ts)) AS reading_s
  FROM want w LEFT JOIN readings r ON r.station = w.station AND CAST(r.ts AS DATE) = CAST(w.ts AS DATE) AND hour(r.ts) = w.h GROUP BY 1)"""


@query(
    "j08_asof_weather",
    B.sql(
        B.READINGS,
        "placed AS (SELECT event_id, user_id % 100 AS station, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
        _ASOF,
        body="SELECT * FROM got",
    ),
)
def _(t):
    rows = t.events.select("event_id", (F.col("user_id") % 100).alias("station"), "ts")
    out = E.asof_weather(rows, B.readings(t), ["event_id"])
    return out.select("event_id", "precipitation", F.col("reading_ts").cast("long").alias("reading_s"))


@query("j07_j08_station_weather", B.sql(B.PINGS, B.STATIONS, B.READINGS, _NEAREST, _ASOF, body="SELECT * FROM got"))
def _(t):
    placed = E.nearest_station(B.pings(t).select("event_id", "ts", "lat", "lon"), B.stations(t), ["event_id"])
    out = E.asof_weather(placed, B.readings(t), ["event_id"])
    return out.select("event_id", "precipitation", F.col("reading_ts").cast("long").alias("reading_s"))


_ROWS = """rows_in AS (SELECT event_id, k // 10 AS cell, 'S' || (bus % 7) AS street, ts, s, lat, lon FROM pings)"""
_ALERTS = """alerts AS (SELECT event_id AS alert_id, k // 10 AS cell, 'S' || (bus % 7) || '-S' || (k % 7) AS street, ts, s, lat, lon, event_id % 11 AS alert_confidence
  FROM pings WHERE route = 'error')"""
_GAP = "CAST(trunc((a.s - r.s) / 60.0) AS BIGINT)"


def _rows(t):
    return B.pings(t).select(
        "event_id", F.expr("k div 10").alias("cell"), F.concat(F.lit("S"), (F.col("bus") % 7).cast("string")).alias("street"), "ts", "lat", "lon"
    )


def _reports(t, kind, name):
    return (
        B.pings(t)
        .where(F.col("route") == kind)
        .select(
            F.col("event_id").alias(name),
            F.expr("k div 10").alias("cell"),
            F.concat(F.lit("S"), (F.col("bus") % 7).cast("string"), F.lit("-S"), (F.col("k") % 7).cast("string")).alias("street"),
            "ts",
            "lat",
            "lon",
            (F.col("event_id") % 11).alias("alert_confidence" if name == "alert_id" else "jam_level"),
        )
    )


_MATCHED = f"""hit AS (SELECT r.event_id, arg_min(a.alert_id, (abs({_GAP}), a.ts, a.alert_id)) AS alert_id
  FROM rows_in r JOIN alerts a ON a.cell = r.cell AND contains(a.street, r.street)
  AND (({_GAP} <= 0 AND {_GAP} > -60) OR ({_GAP} > 0 AND {_GAP} < 10)) GROUP BY 1),
matched AS (SELECT r.*, a.alert_id, a.ts AS alert_ts, a.s AS alert_s, a.lat AS alat, a.lon AS alon, a.alert_confidence
  FROM rows_in r LEFT JOIN hit USING (event_id) LEFT JOIN alerts a ON a.alert_id = hit.alert_id)"""


@query(
    "j09_match_alerts",
    B.sql(
        B.PINGS,
        _ROWS,
        _ALERTS,
        _MATCHED,
        body=f"SELECT event_id, alert_id, alert_confidence, alert_s, round({B.sql_haversine('lat', 'lon', 'alat', 'alon')}, 3) AS alert_m FROM matched",
    ),
)
def _(t):
    out = E.match_alerts(_rows(t), _reports(t, "error", "alert_id"), ["event_id"], ["alert_id", "alert_confidence"])
    return out.select("event_id", "alert_id", "alert_confidence", F.col("alert_ts").cast("long").alias("alert_s"), "alert_m")


@query(
    "j09_containing_pairs",
    """WITH names AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS name FROM orders), texts AS (SELECT DISTINCT c_name AS text FROM customer)
    SELECT name, count(*) AS texts, min(text) AS first_text, max(text) AS last_text FROM names JOIN texts ON contains(text, name) GROUP BY name""",
)
def _(t):
    names = t.orders.select(F.col("o_custkey").cast("string").alias("name"))
    pairs = containing_pairs(names, t.customer.select(F.col("c_name").alias("text")))
    return pairs.groupBy("name").agg(
        F.count(F.lit(1)).alias("texts"), F.min("text").alias("first_text"), F.max("text").alias("last_text")
    )


_JAMS = """jams AS (SELECT event_id AS jam_id, 'S' || (bus % 7) || '-S' || (k % 7) AS street, ts, s, event_id % 11 AS jam_level FROM pings WHERE route = 'view')"""
_JAM_HIT = f"""jhit AS (SELECT r.event_id, arg_min(a.jam_id, (abs({_GAP}), a.ts, a.jam_id)) AS jam_id
  FROM rows_in r JOIN jams a ON CAST(a.ts AS DATE) = CAST(r.ts AS DATE) AND hour(a.ts) = hour(r.ts) AND contains(a.street, r.street)
  AND abs({_GAP}) < 60 GROUP BY 1)"""


@query(
    "j10_match_jams",
    B.sql(
        B.PINGS,
        _ROWS,
        _JAMS,
        _JAM_HIT,
        body="SELECT r.event_id, j.jam_id, j.jam_level, j.s AS jam_s FROM rows_in r LEFT JOIN jhit USING (event_id) LEFT JOIN jams j ON j.jam_id = jhit.jam_id",
    ),
)
def _(t):
    out = E.match_jams(_rows(t), _reports(t, "view", "jam_id"), ["event_id"], ["jam_id", "jam_level"])
    return out.select("event_id", "jam_id", "jam_level", F.col("jam_ts").cast("long").alias("jam_s"))


@query(
    "j19_default_reports",
    B.sql(
        B.PINGS,
        _ROWS,
        _ALERTS,
        _MATCHED,
        _JAMS,
        _JAM_HIT,
        body=f"""SELECT m.event_id, coalesce(m.alert_confidence, 5) AS alert_confidence, coalesce(m.alert_s, m.s) AS alert_s,
        coalesce(m.alat, m.lat) AS alert_lat, coalesce(round({B.sql_haversine('m.lat', 'm.lon', 'alat', 'alon')}, 3), 12.5::DOUBLE) AS alert_m,
        coalesce(j.jam_level, 0) AS jam_level, coalesce(j.s, m.s) AS jam_s, CASE WHEN m.alert_id IS NULL THEN 'NORMAL' ELSE 'JAM' END AS alert_type
        FROM matched m LEFT JOIN jhit USING (event_id) LEFT JOIN jams j ON j.jam_id = jhit.jam_id""",
    ),
)
def _(t):
    alerts = _reports(t, "error", "alert_id").withColumn("alert_type", F.lit("JAM"))
    rows = _rows(t).withColumn("distance_m", F.lit(12.5))
    out = E.match_alerts(rows, alerts, ["event_id"], ["alert_id", "alert_confidence", "alert_type"])
    out = E.with_default_reports(E.match_jams(out, _reports(t, "view", "jam_id"), ["event_id"], ["jam_id", "jam_level"]))
    return out.select(
        "event_id",
        "alert_confidence",
        F.col("alert_ts").cast("long").alias("alert_s"),
        "alert_lat",
        "alert_m",
        "jam_level",
        F.col("jam_ts").cast("long").alias("jam_s"),
        "alert_type",
    )


_INTERP = """filled AS (
  SELECT *, last_value(CASE WHEN known THEN seq END IGNORE NULLS) OVER (PARTITION BY shape ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ps,
         first_value(CASE WHEN known THEN seq END IGNORE NULLS) OVER (PARTITION BY shape ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ns
  FROM (SELECT *, l_returnflag <> 'N' AS known FROM shapes)),
est AS (SELECT f.shape, f.seq, CASE WHEN f.known THEN f.s * 1000 WHEN n.dist = p.dist THEN NULL
  ELSE p.s * 1000 + CAST(trunc((f.dist - p.dist) * ((n.s - p.s) * 1000) / (n.dist - p.dist)) AS BIGINT) END AS est_ms, f.known
  FROM filled f LEFT JOIN shapes p ON p.shape = f.shape AND p.seq = f.ps LEFT JOIN shapes n ON n.shape = f.shape AND n.seq = f.ns)"""


def _timed(t):
    # Both passes of the interpolation read these rows.
    rows = checkpointed(B.shapes(t), "shapes").select(
        "shape", "seq", "dist", F.when(F.col("l_returnflag") != "N", F.col("s") * 1000).alias("at_ms")
    )
    return I.interpolate_times(rows, ["shape"])


@query("w04_interpolate_times", B.sql(B.SHAPES, _INTERP, body="SELECT shape, seq, est_ms, NOT known AND est_ms IS NOT NULL AS interpolated FROM est"))
def _(t):
    return _timed(t).select("shape", "seq", "est_ms", "interpolated")


@query(
    "w05_stops_only",
    B.sql(
        B.SHAPES,
        _INTERP,
        "stops AS (SELECT DISTINCT o_custkey % 200 AS shape, o_orderkey % 500 AS seq FROM orders)",
        body="SELECT shape, seq, est_ms, CASE WHEN NOT known AND est_ms IS NOT NULL THEN 'BETWEEN' ELSE 'NO_PROBLEM' END AS problem FROM est JOIN stops USING (shape, seq)",
    ),
)
def _(t):
    stops = t.orders.select((F.col("o_custkey") % 200).alias("shape"), (F.col("o_orderkey") % 500).alias("seq")).distinct()
    out = I.stops_only(_timed(t).withColumn("problem", F.lit("NO_PROBLEM")), stops)
    return out.select("shape", "seq", "est_ms", "problem")
