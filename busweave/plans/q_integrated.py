"""Queries: integrated rows of 44 and 89 columns, the features made of them, and all stages from the pings on."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.operators import headway as H
from busweave.operators import integrated as N
from busweave.operators import shaping as S
from busweave.plans import bindings as B
from busweave.plans.integration import integrated_visits
from busweave.plans.q_headway import _CALENDAR, _calendar
from busweave.plans.q_matching import _ALL_TRIPS, _TRIP_STOPS, _VISITED, _recursive, _stops, gps, tracks
from busweave.plans.registry import query
from busweave.session import checkpointed

_TEXT_TIME, _SQL_TIME = "yyyy-MM-dd HH:mm:ss", "'%Y-%m-%d %H:%M:%S'"

# --- stop visits as they come from matching: every third was interpolated and has no ping ----------

_PLACED = """placed_visits AS (
  SELECT CAST(event_id AS VARCHAR) AS visit_id, CAST(ts AS DATE) AS day, route, (s // 21600) % 4 AS trip_num, bus % 4 AS shape,
    CASE WHEN route = 'view' THEN '-' WHEN bus % 4 > 1 THEN 'high' ELSE 'low' END AS frequency, k AS seq, lat AS shape_lat, lon AS shape_lon, k * 20.0::DOUBLE AS dist,
    bus, CASE WHEN event_id % 3 > 0 THEN event_id END AS gps_id, CASE WHEN event_id % 3 > 0 THEN lat + 0.001::DOUBLE END AS gps_lat,
    CASE WHEN event_id % 3 > 0 THEN lon - 0.001::DOUBLE END AS gps_lon, CASE WHEN event_id % 3 > 0 THEN value END AS distance_m, ts, s, k % 2 AS stop,
    CASE WHEN event_id % 3 > 0 THEN 'NO_PROBLEM' ELSE 'BETWEEN' END AS problem, CAST(floor(lat * 10) AS BIGINT) AS cell, 'S' || (bus % 7) AS street FROM pings)"""


def _placed(t):
    seen = F.col("event_id") % 3 > 0
    return B.pings(t).select(
        F.col("event_id").cast("string").alias("visit_id"),
        F.to_date("ts").alias("day"),
        "route",
        F.expr("(s div 21600) % 4").alias("trip_num"),
        (F.col("bus") % 4).alias("shape"),
        F.when(F.col("route") == "view", "-").when(F.col("bus") % 4 > 1, "high").otherwise("low").alias("frequency"),
        F.col("k").alias("seq"),
        F.col("lat").alias("shape_lat"),
        F.col("lon").alias("shape_lon"),
        (F.col("k") * F.lit(20.0)).alias("dist"),
        "bus",
        F.when(seen, F.col("event_id")).alias("gps_id"),
        F.when(seen, F.col("lat") + 0.001).alias("gps_lat"),
        F.when(seen, F.col("lon") - 0.001).alias("gps_lon"),
        F.when(seen, F.col("value")).alias("distance_m"),
        "ts",
        (F.col("k") % 2).alias("stop"),
        F.when(seen, "NO_PROBLEM").otherwise("BETWEEN").alias("problem"),
        F.floor(F.col("lat") * 10).alias("cell"),
        F.concat(F.lit("S"), (F.col("bus") % 7).cast("string")).alias("street"),
    )


# --- traffic reports: some fields of some reports are empty ----------------------------------------

_REPORTS = """reports AS (SELECT event_id AS id, CAST(floor(lat * 10) AS BIGINT) AS cell, 'S' || (bus % 7) || '-S' || (k % 7) AS street, ts, s, lat, lon, route, k, event_id AS e FROM pings),
ialerts AS (SELECT id AS alert_id, cell, street, ts, s, lat, lon, CASE WHEN k % 2 = 0 THEN 'HEAVY' END AS alert_subtype, 'JAM' AS alert_type, e % 9 AS alert_road_type,
    e % 11 AS alert_confidence, e % 5 AS alert_comments, e % 3 AS alert_images, e % 13 AS alert_thumbs, e % 10 AS alert_reliability, CASE WHEN e % 4 > 0 THEN e % 4 END AS alert_mood,
    (e % 6)::DOUBLE AS alert_rating, (e % 40) / 4.0::DOUBLE AS alert_speed, e % 2 = 0 AS alert_unified, e % 7 = 0 AS alert_in_scale FROM reports WHERE route = 'error'),
ijams AS (SELECT id AS jam_id, street, ts, s, ts + INTERVAL 30 MINUTE AS jam_expiry, 'SLOW' AS jam_block_type, e % 300 AS jam_delay, e % 900 AS jam_length, e % 6 AS jam_level,
    e % 5 AS jam_severity, (e % 50) / 2.0::DOUBLE AS jam_speed FROM reports WHERE route = 'view')"""


def _reports(t):
    return B.pings(t).withColumns(
        {
            "cell": F.floor(F.col("lat") * 10),
            "street": F.concat(F.lit("S"), (F.col("bus") % 7).cast("string"), F.lit("-S"), (F.col("k") % 7).cast("string")),
            "e": F.col("event_id"),
        }
    )


def _alerts(t):
    e = F.col("e")
    return _reports(t).where("route = 'error'").select(
        e.alias("alert_id"),
        *["cell", "street", "ts", "lat", "lon"],
        F.when(F.col("k") % 2 == 0, "HEAVY").alias("alert_subtype"),
        F.lit("JAM").alias("alert_type"),
        (e % 9).alias("alert_road_type"),
        (e % 11).alias("alert_confidence"),
        (e % 5).alias("alert_comments"),
        (e % 3).alias("alert_images"),
        (e % 13).alias("alert_thumbs"),
        (e % 10).alias("alert_reliability"),
        F.when(e % 4 > 0, e % 4).alias("alert_mood"),
        (e % 6).cast("double").alias("alert_rating"),
        ((e % 40) / F.lit(4.0)).alias("alert_speed"),
        (e % 2 == 0).alias("alert_unified"),
        (e % 7 == 0).alias("alert_in_scale"),
    )


def _jams(t):
    e = F.col("e")
    return _reports(t).where("route = 'view'").select(
        e.alias("jam_id"),
        *["street", "ts"],
        (F.col("ts") + F.expr("INTERVAL 30 MINUTE")).alias("jam_expiry"),
        F.lit("SLOW").alias("jam_block_type"),
        (e % 300).alias("jam_delay"),
        (e % 900).alias("jam_length"),
        (e % 6).alias("jam_level"),
        (e % 5).alias("jam_severity"),
        ((e % 50) / F.lit(2.0)).alias("jam_speed"),
    )


# --- the stages as SQL ------------------------------------------------------------------------------


def _minutes(a: str, b: str) -> str:
    return B.sql_minutes(a, b)


def _stages(source: str) -> tuple[str, ...]:
    """Views from ``source`` (stop visits) to ``integrated``: reading, alert and jam of each visit, neutral ones where none is."""
    place = f"round({B.sql_haversine('p.shape_lat', 'p.shape_lon', 'h.lat', 'h.lon')}, 3)"
    gap, alert_gap = _minutes("v.s", "r.s"), _minutes("v.s", "a.s")
    return (
        f"""place_station AS (SELECT p.shape_lat, p.shape_lon, arg_min(h.station, ({place}, h.station)) AS station, min({place}) AS station_m
  FROM (SELECT DISTINCT shape_lat, shape_lon FROM {source}) p, stations h GROUP BY 1, 2)""",
        "reading_hours AS (SELECT DISTINCT station, CAST(ts AS DATE) AS d, hour(ts) AS h FROM readings)",
        f"""wanted AS (SELECT v.visit_id, v.s, v.ts, p.station, p.station_m, coalesce(min(h.h) FILTER (h.h >= hour(v.ts)), max(h.h) FILTER (h.h < hour(v.ts))) AS h
  FROM {source} v JOIN place_station p USING (shape_lat, shape_lon) LEFT JOIN reading_hours h ON h.station = p.station AND h.d = CAST(v.ts AS DATE) GROUP BY ALL)""",
        f"""weather AS (SELECT v.visit_id, any_value(v.station_m) AS station_m, arg_min(r.precipitation, (abs({gap}), r.ts)) AS precipitation,
    arg_min(r.ts, (abs({gap}), r.ts)) AS reading_ts
  FROM wanted v LEFT JOIN readings r ON r.station = v.station AND CAST(r.ts AS DATE) = CAST(v.ts AS DATE) AND hour(r.ts) = v.h GROUP BY v.visit_id)""",
        f"""alert_of AS (SELECT v.visit_id, arg_min(a.alert_id, (abs({alert_gap}), a.ts, a.alert_id)) AS alert_id
  FROM {source} v JOIN ialerts a ON a.cell = v.cell AND contains(a.street, v.street)
  AND (({alert_gap} <= 0 AND {alert_gap} > -60) OR ({alert_gap} > 0 AND {alert_gap} < 10)) GROUP BY 1)""",
        f"""jam_of AS (SELECT v.visit_id, arg_min(a.jam_id, (abs({alert_gap}), a.ts, a.jam_id)) AS jam_id
  FROM {source} v JOIN ijams a ON CAST(a.ts AS DATE) = CAST(v.ts AS DATE) AND hour(a.ts) = hour(v.ts) AND contains(a.street, v.street)
  AND abs({alert_gap}) < 60 GROUP BY 1)""",
        f"""integrated AS (SELECT v.*, w.precipitation, w.reading_ts, w.station_m,
    coalesce(a.ts, v.ts) AS alert_ts, CASE WHEN a.ts IS NULL THEN 'NORMAL' ELSE a.alert_subtype END AS alert_subtype, coalesce(a.alert_type, 'NORMAL') AS alert_type,
    a.alert_road_type, CASE WHEN a.ts IS NULL THEN 5 ELSE a.alert_confidence END AS alert_confidence, a.alert_comments, a.alert_images, a.alert_thumbs,
    CASE WHEN a.ts IS NULL THEN 10 ELSE a.alert_reliability END AS alert_reliability, a.alert_mood, CASE WHEN a.ts IS NULL THEN 5.0::DOUBLE ELSE a.alert_rating END AS alert_rating,
    a.alert_speed, CASE WHEN a.ts IS NULL THEN v.gps_lat ELSE a.lat END AS alert_lat, CASE WHEN a.ts IS NULL THEN v.gps_lon ELSE a.lon END AS alert_lon,
    CASE WHEN a.ts IS NULL THEN v.distance_m ELSE round({B.sql_haversine('v.shape_lat', 'v.shape_lon', 'a.lat', 'a.lon')}, 3) END AS alert_m, a.alert_unified, a.alert_in_scale,
    coalesce(j.ts, v.ts) AS jam_ts, j.jam_expiry, coalesce(j.jam_block_type, 'NORMAL') AS jam_block_type, coalesce(j.jam_delay, 0) AS jam_delay,
    coalesce(j.jam_length, 0) AS jam_length, coalesce(j.jam_level, 0) AS jam_level, coalesce(j.jam_severity, 0) AS jam_severity, j.jam_speed
  FROM {source} v JOIN weather w USING (visit_id) LEFT JOIN alert_of ao USING (visit_id) LEFT JOIN ialerts a ON a.alert_id = ao.alert_id
  LEFT JOIN jam_of jo USING (visit_id) LEFT JOIN ijams j ON j.jam_id = jo.jam_id)""",
    )


def _labels(scheduled: str) -> tuple[str, ...]:
    """Views from ``integrated`` to ``labelled_rows``: next bus of the day, service, scheduled interval, threshold, label."""
    nxt = ", ".join(f"lead({c}) OVER w AS n_{c}" for c in ("s", *dict.fromkeys(N.NEXT.values())))
    return (
        scheduled,
        f"following AS (SELECT *, {nxt} FROM integrated WINDOW w AS (PARTITION BY day, route, shape, stop ORDER BY ts, bus))",
        "services AS (SELECT d, coalesce((SELECT min(service_id) FROM calendar c WHERE c.dow = isodow(d) - 1 AND d <= c.end_date), 1) AS service_id"
        " FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM integrated))",
        """held AS (SELECT f.visit_id, arg_min(q.sched_min, (q.first_arr, q.second_arr)) AS sched_min FROM following f JOIN services x ON x.d = CAST(f.ts AS DATE)
  JOIN isched q ON q.route = f.route AND q.shape = f.shape AND q.stop = f.stop AND q.service_id = x.service_id AND f.n_s IS NOT NULL
  AND q.first_arr <= f.s % 86400 AND f.s % 86400 <= f.n_s % 86400 AND f.n_s % 86400 <= q.second_arr GROUP BY 1)""",
        f"""labelled_rows AS (SELECT f.*, {_minutes('s', 'n_s')} AS headway_min, coalesce(CAST(floor(sched_min / 4) AS BIGINT), 5) AS threshold_min,
    {_minutes('s', 'n_s')} <= coalesce(CAST(floor(sched_min / 4) AS BIGINT), 5) AS bunched, CAST(hour(ts) AS INTEGER) AS gps_hour
  FROM following f LEFT JOIN held USING (visit_id) WHERE n_s IS NOT NULL AND bus <> n_bus)""",
    )


_TIMES = ("ts", "reading_ts", "alert_ts", "jam_ts", "jam_expiry")
_FLAGS = ("alert_unified", "alert_in_scale")
_ROUNDED = {"shape_lat", "shape_lon", "gps_lat", "gps_lon", "distance_m", "alert_lat", "alert_lon", "alert_m", "station_m", "precipitation", "dist"}


def _sql_columns(columns: dict[str, str], suffix: str = "", prefix: str = "", text_times: bool = True) -> str:
    """Select list of a layout: times as text, flags that may be missing as 0 and 1, measured numbers rounded."""

    def shown(c: str) -> str:
        if c in _TIMES:
            return f"strftime({prefix}{c}, {_SQL_TIME})" if text_times else f"{prefix}{c}"
        if c in _FLAGS:
            return f"CAST({prefix}{c} AS INTEGER)"
        return f"round({prefix}{c}, 6)" if c in _ROUNDED else f"{prefix}{c}"

    return ", ".join(f'{shown(c)} AS "{name}{suffix}"' for name, c in columns.items())


def _shown(df, text_times: bool = True):
    """Times as text, flags as 0 and 1 and rounded numbers, so that both engines print the same."""
    out = {}
    for name, c in {**N.INTEGRATED, **{f"{k}SB": v for k, v in N.NEXT.items()}}.items():
        if name in df.columns and c in _TIMES and text_times:
            out[name] = F.date_format(name, _TEXT_TIME)
        elif name in df.columns and c in _FLAGS:
            out[name] = F.col(name).cast("int")
        elif name in df.columns and c in _ROUNDED:
            out[name] = F.round(name, 6)
    return df.withColumns(out)


_SOURCES = (B.PINGS, B.STATIONS, B.READINGS, _PLACED, _REPORTS, *_stages("placed_visits"))
_LABELLED_COLUMNS = f"{_sql_columns({**N.INTEGRATED, **N.LABEL_PART})}, {_sql_columns(N.NEXT, 'SB', 'n_')}"


def _integrated(t):
    return N.integrate(_placed(t), B.stations(t), B.readings(t), _alerts(t), _jams(t))


@query("i01_integrated_rows", B.sql(*_SOURCES, body=f"SELECT {_sql_columns(N.INTEGRATED)} FROM integrated"))
def _(t):
    return _shown(N.integrated_columns(_integrated(t)))


# Timetable of every route, shape and stop, one departure per order.
_ISCHED = """itimes AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][1 + o_orderkey % 5] AS route, o_custkey % 4 AS shape, (o_custkey // 4) % 2 AS stop, (o_orderkey // 5) % 3 AS service_id,
    CAST((o_orderkey * 37) % 86400 AS INTEGER) // 3600 * 3600 AS arrival_s FROM orders),
isched AS (SELECT route, shape, stop, service_id, arrival_s AS first_arr, second_arr, (second_arr - arrival_s) // 60 AS sched_min
  FROM (SELECT *, lead(arrival_s) OVER (PARTITION BY route, shape, stop, service_id ORDER BY arrival_s) AS second_arr FROM (SELECT DISTINCT * FROM itimes)) WHERE second_arr IS NOT NULL)"""


def _scheduled(t):
    kinds = F.array(*[F.lit(r) for r in B.ROUTE_NUMBERS])
    times = t.orders.select(
        F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("route"),
        (F.col("o_custkey") % 4).alias("shape"),
        F.expr("(o_custkey div 4) % 2").alias("stop"),
        F.expr("(o_orderkey div 5) % 3").alias("service_id"),
        F.expr("cast((o_orderkey * 37) % 86400 as int) div 3600 * 3600").alias("arrival_s"),
    )
    return H.scheduled_headways(times, ["route", "shape", "stop", "service_id"], distinct=True)


def _labelled(t, carry=tuple(N.NEXT.values())):
    return N.label_visits(checkpointed(_integrated(t), "integrated"), _scheduled(t), _calendar(t), carry=carry)


_LABEL_VIEWS = (_CALENDAR, *_labels(_ISCHED))


@query("i02_labelled_rows", B.sql(*_SOURCES, *_LABEL_VIEWS, body=f"SELECT {_LABELLED_COLUMNS} FROM labelled_rows"))
def _(t):
    return _shown(N.labelled_columns(_labelled(t)))


# --- features -----------------------------------------------------------------------------------------

_PARTS = {"DAY": "day", "YEAR": "year", "MONTH": "month", "WEEKDAY": "isodow"}
_WIDE = f"""wide AS (SELECT {_sql_columns({**N.INTEGRATED, **N.LABEL_PART}, text_times=False)}, {_sql_columns(N.NEXT, 'SB', 'n_', False)} FROM labelled_rows)"""
_DATE_COLUMNS = ", ".join(
    f'CAST({fn}("{c}{s}"){" - 1" if part == "WEEKDAY" else ""} AS INTEGER) AS "{part}({c}{s})"'
    for s in ("", "SB")
    for c in N.DATED
    for part, fn in _PARTS.items()
)
_LEFT_OUT = ", ".join(f'"{c}{s}"' for s in ("", "SB") for c in (*N.DATED, *N.UNDATED))
_DATED_VIEW = f"dated AS (SELECT * EXCLUDE ({_LEFT_OUT}), {_DATE_COLUMNS} FROM wide)"


@query("i03_date_features", B.sql(*_SOURCES, *_LABEL_VIEWS, _WIDE, _DATED_VIEW, body="SELECT * FROM dated"))
def _(t):
    return N.with_date_features(_shown(N.labelled_columns(_labelled(t)), text_times=False))


def _filled_sql() -> str:
    new = {"busBunching": 'CAST("busBunching" AS INTEGER)'}
    for s in ("", "SB"):
        new |= {f"{c}{s}": f'coalesce("{c}{s}", 0)' for c in ("alertIsJamUnifiedAlert", "alertInScale")}
        new |= {f"{c}{s}": f'coalesce("{c}{s}", 0)' for c in ("gpsPointId", "distanceToShapePoint", "alertDistanceToClosestShapePoint")}
        new |= {f"{c}{s}": f'coalesce("{c}{s}", "{by}{s}")' for c, by in (("gpsLat", "shapeLat"), ("gpsLon", "shapeLon"), ("alertLatitude", "shapeLat"), ("alertLongitude", "shapeLon"))}
        gaps = ["precipitation", "alertRoadType", "alertNComments", "alertNImages", "alertNThumbsUp", "alertReportMood", "alertSpeed", "jamSpeedKM"]
        gaps += [f"{part}(precipitationTime{s})" for part in _PARTS]
        for c in gaps:
            name = c if "(" in c else c + s
            new[name] = f'coalesce("{name}", median("{name}") OVER (PARTITION BY "WEEKDAY(gps_datetime)"))'
    return ", ".join(f'{v} AS "{k}"' for k, v in new.items())


@query(
    "i04_model_rows",
    B.sql(*_SOURCES, *_LABEL_VIEWS, _WIDE, _DATED_VIEW, f"filled AS (SELECT * REPLACE ({_filled_sql()}) FROM dated)", body="SELECT * FROM filled"),
)
def _(t):
    rows = checkpointed(N.with_date_features(_shown(N.labelled_columns(_labelled(t)), text_times=False)), "dated")
    return N.model_rows(rows)


def _group_sql(*groups: str) -> str:
    wanted = {c for g in groups for c in S.FEATURE_GROUPS[g]}
    plain = [c for c in [*N.INTEGRATED, *N.LABEL_PART] if c in wanted] + [f"{c}SB" for c in N.NEXT if c in wanted]
    parts = [f"{part}({c}{s})" for s in ("", "SB") for g in groups for c in S.FEATURE_DATES.get(g, ()) for part in _PARTS]
    return ", ".join(f'"{c}"' for c in plain + parts)


for _name, _groups in (("gps_gtfs", ("gps", "gtfs")), ("weather", ("gps", "gtfs", "weather")), ("traffic", ("gps", "gtfs", "traffic"))):

    @query(f"p11_group_{_name}", B.sql(*_SOURCES, *_LABEL_VIEWS, _WIDE, _DATED_VIEW, body=f"SELECT {_group_sql(*_groups)} FROM dated"))
    def _(t, groups=_groups):
        wanted = {c for g in groups for c in (*S.FEATURE_GROUPS[g], *S.FEATURE_DATES.get(g, ()))}
        carry = [v for k, v in N.NEXT.items() if k in wanted]
        return S.feature_group(N.with_date_features(_shown(N.labelled_columns(_labelled(t, carry)), text_times=False)), *groups)


# --- all stages, from the pings on ---------------------------------------------------------------------

_CHAIN = """chain_visits AS (
  SELECT v.day, v.bus, v.trip_num, v.shape, v.seq, v.dist, v.problem, make_timestamp(v.est_ms * 1000) AS ts, CAST(floor(v.est_ms / 1000) AS BIGINT) AS s, v.seq AS stop,
    concat_ws('|', CAST(v.day AS VARCHAR), v.bus, v.trip_num, v.shape, v.seq) AS visit_id, h.route, CASE WHEN v.shape % 2 = 0 THEN 'high' ELSE 'low' END AS frequency,
    h.lat AS shape_lat, h.lon AS shape_lon, CAST(floor(h.lat * 10) AS BIGINT) AS cell, 'S' || (v.seq % 7) AS street, m.gps_id, m.lat AS gps_lat, m.lon AS gps_lon, m.distance_m
  FROM visited v JOIN tracks h ON h.shape = v.shape AND h.seq = v.seq LEFT JOIN (
    SELECT x.day, x.bus, x.trip_num, x.shape, x.shape_seq, x.gps_id, g.lat, g.lon, x.distance_m FROM matched x JOIN gps g ON g.gps_id = x.gps_id WHERE x.shape_seq IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY x.day, x.bus, x.trip_num, x.shape, x.shape_seq ORDER BY x.ts DESC, x.gps_id DESC) = 1) m
  ON m.day = v.day AND m.bus = v.bus AND m.trip_num = v.trip_num AND m.shape = v.shape AND m.shape_seq = v.seq)"""
# Twelve departures a day of each stop of each shape.
_CHAIN_SCHED = """itimes AS (SELECT DISTINCT x.route, l.shape, l.seq AS stop, l.seq % 3 AS service_id, CAST(h * 7200 + l.seq % 1800 AS INTEGER) AS arrival_s
  FROM stop_list l JOIN (SELECT DISTINCT shape, route FROM tracks) x USING (shape), range(12) r(h)),
isched AS (SELECT route, shape, stop, service_id, arrival_s AS first_arr, second_arr, (second_arr - arrival_s) // 60 AS sched_min
  FROM (SELECT *, lead(arrival_s) OVER (PARTITION BY route, shape, stop, service_id ORDER BY arrival_s) AS second_arr FROM itimes) WHERE second_arr IS NOT NULL)"""


@query(
    "i05_all_stages",
    _recursive(
        B.PINGS, B.STATIONS, B.READINGS, _REPORTS, *_ALL_TRIPS, _TRIP_STOPS, _VISITED, _CHAIN, *_stages("chain_visits"), _CALENDAR, *_labels(_CHAIN_SCHED),
        body=f"SELECT {_LABELLED_COLUMNS} FROM labelled_rows",
    ),
)
def _(t):
    shapes = checkpointed(
        tracks(t).withColumns(
            {"cell": F.floor(F.col("lat") * 10), "street": F.concat(F.lit("S"), (F.col("seq") % 7).cast("string"))}
        ),
        "tracks",
    )
    routes = shapes.select("shape", "route").distinct().withColumn("frequency", F.when(F.col("shape") % 2 == 0, "high").otherwise("low"))
    stops = _stops(t)
    times = stops.join(routes, "shape").select(
        "route",
        "shape",
        F.col("seq").alias("stop"),
        (F.col("seq") % 3).alias("service_id"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda h: (h * 7200 + F.col("seq") % 1800).cast("int"))).alias("arrival_s"),
    )
    scheduled = H.scheduled_headways(times, ["route", "shape", "stop", "service_id"], distinct=True)
    out = integrated_visits(
        gps(t), shapes, stops, routes, B.stations(t), B.readings(t), _alerts(t), _jams(t), scheduled, _calendar(t)
    )
    return _shown(N.labelled_columns(out))
