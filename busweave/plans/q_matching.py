"""Queries: map matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.operators import matching as M
from busweave.plans import bindings as B
from busweave.plans.integration import labelled_visits, match_trips, stop_visits
from busweave.plans.registry import query
from busweave.session import checkpointed

# Five vehicles, lines from event types, twelve shapes (three per line) with lengths in metres.
_GPS = """gps AS (
  SELECT CAST(ts AS DATE) AS day, user_id % 5 AS bus, event_id AS gps_id, ts, epoch(ts) AS es,
         CASE event_type WHEN 'error' THEN 'REC' ELSE event_type END AS line_code,
         -25.0 - CAST(regexp_extract(props, '[0-9]+') AS INTEGER) / 200.0::DOUBLE AS lat, -49.0 - value / 1000.0::DOUBLE AS lon,
         row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 5 ORDER BY ts, event_id) - 1 AS idx
  FROM events)"""


def gps(t):
    return B.pings(t).select(
        F.to_date("ts").alias("day"),
        (F.col("bus") % 5).alias("bus"),
        F.col("event_id").alias("gps_id"),
        "ts",
        F.when(F.col("route") == "error", "REC").otherwise(F.col("route")).alias("line_code"),
        "lat",
        "lon",
    )


_TRACKS = """tracks AS (
  SELECT l_orderkey % 12 AS shape, ['click', 'purchase', 'signup', 'view'][1 + l_orderkey % 4] AS route,
         row_number() OVER w AS seq, sum(l_quantity * 20) OVER (w ROWS UNBOUNDED PRECEDING) AS dist,
         -25.0 - (l_partkey % 100) / 200.0::DOUBLE AS lat, -49.0 - (l_suppkey % 50) / 100.0::DOUBLE AS lon
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey % 12 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate))"""


def tracks(t):
    from busweave.operators.ordered import blocks_of, over_slices, position, running_sum

    routes = F.array(*[F.lit(r) for r in ("click", "purchase", "signup", "view")])
    keyed = t.lineitem.withColumn("shape", F.col("l_orderkey") % 12)
    placed = over_slices(
        keyed, ["shape"], B.SHAPE_ORDER, blocks_of("l_orderkey", 1024), seq=position(), dist=running_sum(F.col("l_quantity") * 20)
    )
    return placed.select(
        "shape",
        F.element_at(routes, (F.col("shape") % 4 + 1).cast("int")).alias("route"),
        "seq",
        "dist",
        (F.lit(-25.0) - (F.col("l_partkey") % 100) / F.lit(200.0)).alias("lat"),
        (F.lit(-49.0) - (F.col("l_suppkey") % 50) / F.lit(100.0)).alias("lon"),
    )


_LINES = f"""vlines AS (
  SELECT day, bus, count(*) AS pings, coalesce(max(round(d, 3)), 0) AS greatest_gap_m, arg_min(line_code, (ts, gps_id)) FILTER (line_code <> 'REC') AS route
  FROM (SELECT *, {B.sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM gps WINDOW w AS (PARTITION BY day, bus ORDER BY ts, gps_id))
  GROUP BY day, bus)"""

_SLINES = f"""slines0 AS (
  SELECT shape, any_value(route) AS route, count(*) AS points, max(dist) AS total_m, coalesce(max(round(d, 3)), 0) AS greatest_gap_m,
         arg_min(lat, seq) AS start_lat, arg_min(lon, seq) AS start_lon, arg_max(lat, seq) AS end_lat, arg_max(lon, seq) AS end_lon
  FROM (SELECT *, {B.sql_haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM tracks WINDOW w AS (PARTITION BY shape ORDER BY seq))
  GROUP BY shape),
slines AS (SELECT *, CAST(floor(total_m / (points * 0.09::DOUBLE)) AS INTEGER) AS threshold_m,
  {B.sql_haversine('start_lat', 'start_lon', 'end_lat', 'end_lon')} <= greatest_gap_m AS round_trip FROM slines0)"""


@query("a01_vehicle_lines", B.sql(_GPS, _LINES, body="SELECT CAST(day AS VARCHAR) AS day, bus, pings, greatest_gap_m, route FROM vlines"))
def _(t):
    return M.vehicle_lines(gps(t)).withColumn("day", F.col("day").cast("string"))


@query("a02_shape_lines", B.sql(_TRACKS, _SLINES, body="SELECT * FROM slines"))
def _(t):
    return M.shape_lines(tracks(t))


@query(
    "j01_lines_with_shapes",
    B.sql(_GPS, _LINES, _TRACKS, _SLINES, body="SELECT CAST(day AS VARCHAR) AS day, bus, v.route, shape, threshold_m FROM vlines v LEFT JOIN slines s ON s.route = v.route"),
)
def _(t):
    out = M.lines_with_shapes(M.vehicle_lines(gps(t)), M.shape_lines(tracks(t)))
    return out.select(F.col("day").cast("string").alias("day"), "bus", "route", "shape", "threshold_m")


# In these tables every start lies near some end, so all shapes are treated as one-way in the single steps.
def _cand(lines):
    return f"""cand AS (
  SELECT day, bus, shape, idx, ts, es, side, CASE WHEN side = 'START' OR round_trip THEN 'FIRST' ELSE 'LAST' END AS kind,
         CASE WHEN side = 'START' OR round_trip THEN ds ELSE de END AS end_m
  FROM (SELECT *, CASE WHEN ds < threshold_m THEN 'START' WHEN de < threshold_m THEN 'END' END AS side
        FROM (SELECT g.day, g.bus, g.idx, g.ts, g.es, s.shape, s.threshold_m, s.round_trip,
                     round({B.sql_haversine('g.lat', 'g.lon', 's.start_lat', 's.start_lon')}, 3) AS ds,
                     round({B.sql_haversine('g.lat', 'g.lon', 's.end_lat', 's.end_lon')}, 3) AS de
              FROM gps g JOIN vlines v ON v.day = g.day AND v.bus = g.bus JOIN {lines} s ON s.route = v.route
              WHERE g.line_code <> 'REC'))
  WHERE side IS NOT NULL)"""

_ONE_WAY = "wlines AS (SELECT * REPLACE (false AS round_trip) FROM slines)"
_TAGS = """brk AS (SELECT *, coalesce(es - lag(es) OVER w > 600, true) AS b FROM cand WINDOW w AS (PARTITION BY day, bus, shape ORDER BY idx)),
brk2 AS (SELECT *, max(CASE WHEN b AND side = 'START' THEN idx END) OVER w AS ls, max(CASE WHEN b AND side = 'END' THEN idx END) OVER w AS le
  FROM brk WINDOW w AS (PARTITION BY day, bus, shape ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tagged AS (SELECT *, last_value(CASE WHEN b AND idx > coalesce(CASE side WHEN 'START' THEN ls ELSE le END, -2) + 1 THEN substr(strftime(ts, '%H%M'), 1, 3) END IGNORE NULLS)
  OVER (PARTITION BY day, bus, shape ORDER BY idx ROWS UNBOUNDED PRECEDING) AS tag FROM brk2)"""

_RUNS = """runs AS (SELECT *, sum(CASE WHEN p = tag THEN 0 ELSE 1 END) OVER (PARTITION BY day, bus, shape, kind ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(tag) OVER (PARTITION BY day, bus, shape, kind ORDER BY idx) AS p FROM tagged)),
closest AS (SELECT day, bus, shape, kind, CAST(run AS BIGINT) AS run, arg_min(idx, (end_m, idx)) AS idx, any_value(tag) AS tag FROM runs GROUP BY 1, 2, 3, 4, 5)"""


def _one_way(t):
    return M.shape_lines(tracks(t)).withColumn("round_trip", F.lit(False))


def _candidates(t):
    pings = checkpointed(M.number_pings(gps(t)), "pings")
    return M.candidate_points(pings, M.vehicle_lines(pings), checkpointed(_one_way(t), "shape-lines"))


_BASE = (_GPS, _LINES, _TRACKS, _SLINES, _ONE_WAY, _cand("wlines"))


@query("g01_candidate_points", B.sql(*_BASE, body="SELECT CAST(day AS VARCHAR) AS day, bus, shape, idx, side, kind, end_m FROM cand"))
def _(t):
    return _candidates(t).drop("ts").withColumn("day", F.col("day").cast("string"))


@query("w19_tag_candidates", B.sql(*_BASE, _TAGS, body="SELECT CAST(day AS VARCHAR) AS day, bus, shape, idx, kind, tag FROM tagged"))
def _(t):
    out = M.tag_candidates(_candidates(t))
    return out.select(F.col("day").cast("string").alias("day"), "bus", "shape", "idx", "kind", "tag")


@query("w18_closest_per_tag", B.sql(*_BASE, _TAGS, _RUNS, body="SELECT CAST(day AS VARCHAR) AS day, bus, shape, kind, run, idx, tag FROM closest"))
def _(t):
    return M.closest_per_tag(M.tag_candidates(_candidates(t))).withColumn("day", F.col("day").cast("string"))


def _pairs(t):
    return checkpointed(M.pair_trips(M.closest_per_tag(M.tag_candidates(_candidates(t)))), "pairs")


# Start points are taken one by one, each looking through the end points that are left.
_PAIRED = """lists AS (SELECT day, bus, shape, list(idx ORDER BY idx) FILTER (kind = 'FIRST') AS firsts, list(idx ORDER BY idx) FILTER (kind = 'LAST') AS lasts
  FROM closest GROUP BY day, bus, shape),
pairing AS (
  SELECT day, bus, shape, firsts, lasts AS rest, 0::BIGINT AS n, 0::BIGINT AS closed, []::STRUCT(a BIGINT, b BIGINT, broken BOOLEAN)[] AS found
  FROM lists WHERE firsts IS NOT NULL AND lasts IS NOT NULL
  UNION ALL
  SELECT day, bus, shape, firsts, CASE WHEN inside THEN rest ELSE later[2:] END, n + 1, CASE WHEN inside THEN closed ELSE coalesce(later[1], closed) END,
    CASE WHEN NOT inside THEN found || CASE WHEN n > 0 THEN list_transform(list_filter(rest, lambda e: e <= s), lambda e: {'a': closed, 'b': e, 'broken': true}) ELSE [] END
           || CASE WHEN len(later) > 0 THEN [{'a': s, 'b': later[1], 'broken': false}] ELSE [] END
         WHEN len(found) > 0 THEN found[:-2] || [{'a': found[-1].a, 'b': s, 'broken': true}, {'a': s + 1, 'b': found[-1].b, 'broken': false}]
         ELSE found END
  FROM (SELECT *, list_filter(rest, lambda e: e > s) AS later FROM
    (SELECT *, firsts[n + 1] AS s, n > 0 AND firsts[n + 1] <= closed AS inside FROM pairing WHERE n < len(firsts) AND len(rest) > 0))),
listed AS (
  SELECT day, bus, shape, arg_max(found, n) AS found FROM pairing GROUP BY day, bus, shape
  UNION ALL
  SELECT day, bus, shape, list_transform(range(1, len(p)), lambda i: {'a': p[i] + CASE WHEN i = 1 THEN 0 ELSE 1 END, 'b': p[i + 1], 'broken': false})
  FROM (SELECT *, coalesce(firsts, lasts) AS p FROM lists WHERE firsts IS NULL OR lasts IS NULL)),
pairs AS (SELECT day, bus, shape, CAST(u.i AS INTEGER) AS trip_num, found[u.i].a AS first_idx, found[u.i].b AS last_idx, found[u.i].broken AS broken
  FROM listed, unnest(range(1, len(found) + 1)) u(i))"""


def _chosen_sql(lines):
    near = f"{B.sql_haversine('a.start_lat', 'a.start_lon', 'b.end_lat', 'b.end_lon')} < b.greatest_gap_m AND {B.sql_haversine('a.end_lat', 'a.end_lon', 'b.start_lat', 'b.start_lon')} < b.greatest_gap_m"
    return f"""routes AS (SELECT route, count(*) AS n_shapes, bool_or(round_trip) AS any_round FROM {lines} GROUP BY route),
heads AS (SELECT p.day, p.bus, v.route, p.shape, count(*) AS trips, min(first_idx) FILTER (trip_num = 1) AS first, min(last_idx - first_idx) FILTER (trip_num = 1) AS span
  FROM pairs p JOIN vlines v ON v.day = p.day AND v.bus = p.bus GROUP BY ALL),
seen AS (SELECT h.*, CASE WHEN NOT any_round AND n_shapes > 2 THEN 'OPPOSITE' WHEN any_round AND n_shapes > 1 THEN 'FIRST' ELSE 'ALL' END AS rule FROM heads h JOIN routes USING (route)),
early AS (SELECT *, row_number() OVER (PARTITION BY day, bus ORDER BY first, shape) AS place, count(*) OVER (PARTITION BY day, bus) AS others
  FROM seen WHERE rule = 'OPPOSITE' AND trips > 1),
winner AS (SELECT day, bus, route, arg_max(shape, (CASE WHEN place = 1 THEN span ELSE span + 0.5 END, place)) AS shape FROM early WHERE place <= 2 AND others >= 2 GROUP BY ALL),
partner AS (SELECT w.day, w.bus, arg_min(b.shape, (s.first IS NOT NULL, coalesce(s.first, 0), b.shape)) AS shape
  FROM winner w JOIN {lines} a ON a.shape = w.shape JOIN {lines} b ON b.route = a.route AND {near}
  LEFT JOIN seen s ON s.day = w.day AND s.bus = w.bus AND s.shape = b.shape GROUP BY ALL),
rest_of AS (SELECT * FROM seen WHERE rule = 'ALL' UNION ALL SELECT * FROM seen s WHERE rule = 'OPPOSITE' AND NOT EXISTS (SELECT 1 FROM winner w WHERE w.day = s.day AND w.bus = s.bus)),
chosen AS (SELECT day, bus, shape, 1 AS rank FROM winner UNION ALL SELECT day, bus, shape, 2 FROM partner
  UNION ALL SELECT day, bus, shape, 1 FROM seen WHERE rule = 'FIRST' QUALIFY row_number() OVER (PARTITION BY day, bus ORDER BY first, span DESC, shape) = 1
  UNION ALL SELECT day, bus, shape, CAST(row_number() OVER (PARTITION BY day, bus ORDER BY first, shape) AS INTEGER) FROM rest_of)"""


# Trips are laid down one by one; ``done`` remembers what each left behind under its number.
_CLIPPED = """laying AS (SELECT p.*, row_number() OVER (PARTITION BY p.day, p.bus ORDER BY rank, p.shape, trip_num) AS k FROM pairs p JOIN chosen c ON c.day = p.day AND c.bus = p.bus AND c.shape = p.shape),
laid AS (
  SELECT day, bus, 0::BIGINT AS k, []::STRUCT(shape BIGINT, n INTEGER, a BIGINT, b BIGINT, broken BOOLEAN, kept BOOLEAN, taken BIGINT)[] AS done FROM (SELECT DISTINCT day, bus FROM laying)
  UNION ALL
  SELECT day, bus, k, done || [{'shape': shape, 'n': n, 'a': a, 'b': b, 'broken': broken, 'kept': a < b, 'taken': CASE WHEN a < b THEN b WHEN a > own + 1 THEN a END}]
  FROM (SELECT *, greatest(first_idx, before + 1, own + 1) AS a, least(last_idx, list_filter(done, lambda d: d.n = trip_num + 1 AND d.kept)[1].a) AS b
    FROM (SELECT l.day, l.bus, t.k, l.done, t.shape, t.trip_num, t.trip_num AS n, t.first_idx, t.last_idx, t.broken,
            list_filter(l.done, lambda d: d.n = t.trip_num AND d.taken IS NOT NULL)[-1].taken AS own,
            list_filter(l.done, lambda d: d.n = t.trip_num - 1 AND d.taken IS NOT NULL)[-1].taken AS before
          FROM laid l JOIN laying t ON t.day = l.day AND t.bus = l.bus AND t.k = l.k + 1))),
trips AS (SELECT day, bus, d.shape AS shape, d.n AS trip_num, d.a AS first_idx, d.b AS last_idx, CASE WHEN d.broken THEN 'TRIP_PROBLEM' ELSE 'NO_PROBLEM' END AS problem
  FROM (SELECT day, bus, unnest(done) AS d FROM laid WHERE (day, bus, k) IN (SELECT day, bus, max(k) FROM laid GROUP BY day, bus)) WHERE d.kept)"""


def _recursive(*views, body):
    return B.sql(*views, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


_ONE_WAY_PAIRS = (*_BASE, _TAGS, _RUNS, _PAIRED)
_KEY = "CAST(day AS VARCHAR) AS day, CAST(bus AS VARCHAR) AS bus"


@query("g02_pair_trips", _recursive(*_ONE_WAY_PAIRS, body=f"SELECT {_KEY}, shape, trip_num, first_idx, last_idx, broken FROM pairs"))
def _(t):
    return _pairs(t).withColumn("day", F.col("day").cast("string"))


@query(
    "j17_complementary_shape",
    B.sql(
        _TRACKS,
        _SLINES,
        _GPS,
        _LINES,
        body=f"""SELECT CAST(v.day AS VARCHAR) AS day, v.bus, a.shape, b.shape AS partner FROM vlines v JOIN slines a ON a.route = v.route JOIN slines b ON b.route = a.route
        WHERE {B.sql_haversine('a.start_lat', 'a.start_lon', 'b.end_lat', 'b.end_lon')} < b.greatest_gap_m
        AND {B.sql_haversine('a.end_lat', 'a.end_lon', 'b.start_lat', 'b.start_lon')} < b.greatest_gap_m""",
    ),
)
def _(t):
    used = ["shape", "route", "greatest_gap_m", "start_lat", "start_lon", "end_lat", "end_lon"]
    lines = checkpointed(M.shape_lines(tracks(t)).select(*used), "shape-lines")
    vehicles = M.vehicle_lines(gps(t)).select("day", "bus", "route")
    out = M.complementary_shape(lines, vehicles.join(lines.select("route", "shape"), "route"))
    return out.withColumn("day", F.col("day").cast("string"))


@query("g03_choose_shapes", _recursive(*_ONE_WAY_PAIRS, _chosen_sql("wlines"), body=f"SELECT {_KEY}, shape, rank FROM chosen"))
def _(t):
    return _chosen(t, _pairs(t)).withColumn("day", F.col("day").cast("string"))


def _chosen(t, pairs):
    lines = checkpointed(_one_way(t), "shape-lines")
    return M.choose_shapes(pairs, checkpointed(M.vehicle_lines(gps(t)), "vehicle-lines"), lines)


def _trips(t):
    pairs = _pairs(t)
    return M.build_trips(pairs, checkpointed(_chosen(t, pairs), "chosen"))


@query(
    "g04_build_trips",
    _recursive(*_ONE_WAY_PAIRS, _chosen_sql("wlines"), _CLIPPED, body=f"SELECT {_KEY}, shape, trip_num, first_idx, last_idx, problem FROM trips"),
)
def _(t):
    return _trips(t).withColumn("day", F.col("day").cast("string"))


# Trips given by plain SQL, so the range join itself can be checked: one trip per 20 pings, 15 long.
_SPANS = """spans AS (SELECT DISTINCT day, bus, 3 AS shape, CAST(idx // 20 + 1 AS INTEGER) AS trip_num, idx // 20 * 20 + 2 AS first_idx, idx // 20 * 20 + 16 AS last_idx FROM gps)"""


def _spans(t):
    pings = M.number_pings(gps(t))
    n = F.expr("idx div 20")
    return pings.select(
        "day",
        F.col("bus").cast("string").alias("bus"),
        F.lit(3).alias("shape"),
        (n + 1).cast("int").alias("trip_num"),
        (n * 20 + 2).alias("first_idx"),
        (n * 20 + 16).alias("last_idx"),
        F.lit("NO_PROBLEM").alias("problem"),
    ).distinct()


@query(
    "j18_assign_trip",
    B.sql(_GPS, _SPANS, body="SELECT gps_id, g.idx, s.trip_num FROM gps g LEFT JOIN spans s ON s.day = g.day AND s.bus = g.bus AND g.idx BETWEEN s.first_idx AND s.last_idx"),
)
def _(t):
    return M.assign_trip(M.number_pings(gps(t)), _spans(t)).select("gps_id", "idx", "trip_num")


@query(
    "g05_outlier_points",
    B.sql(
        _GPS,
        _SPANS,
        body="""SELECT gps_id, coalesce(s.trip_num, CAST(greatest(1, CASE WHEN g.idx % 20 < 2 THEN g.idx // 20 ELSE g.idx // 20 + 1 END) AS INTEGER)) AS trip_num,
        CASE WHEN s.trip_num IS NULL THEN 'OUTLIER_POINT' ELSE 'NO_PROBLEM' END AS trip_problem
        FROM gps g LEFT JOIN spans s ON s.day = g.day AND s.bus = g.bus AND g.idx BETWEEN s.first_idx AND s.last_idx""",
    ),
)
def _(t):
    spans = _spans(t)
    out = M.outlier_points(M.assign_trip(M.number_pings(gps(t)), spans), spans)
    return out.select("gps_id", "trip_num", "trip_problem")


_NEAR = f"round({B.sql_haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')}, 3)"
_MATCHED = f"""assigned AS (SELECT g.day, g.bus, g.idx, any_value(g.gps_id) AS gps_id, any_value(g.ts) AS ts, any_value(g.lat) AS lat, any_value(g.lon) AS lon,
    min((t.trip_num, t.first_idx, t.shape, t.problem)) FILTER (t.trip_num IS NOT NULL) AS t
  FROM gps g LEFT JOIN trips t ON t.day = g.day AND t.bus = g.bus AND g.idx BETWEEN t.first_idx AND t.last_idx GROUP BY g.day, g.bus, g.idx),
numbered AS (SELECT a.* EXCLUDE (t), t[1] AS own_num, t[3] AS shape, t[4] AS own_problem, EXISTS (SELECT 1 FROM trips x WHERE x.day = a.day AND x.bus = a.bus) AS any_trip FROM assigned a),
labelled AS (SELECT *, CASE WHEN any_trip THEN coalesce(own_num, last_value(own_num IGNORE NULLS) OVER (PARTITION BY day, bus ORDER BY idx ROWS UNBOUNDED PRECEDING), 1) END AS trip_num,
    coalesce(own_problem, CASE WHEN any_trip THEN 'OUTLIER_POINT' ELSE 'NO_SHAPE' END) AS trip_problem FROM numbered),
located AS (SELECT p.day, p.bus, p.idx, arg_min(h.seq, ({_NEAR}, -h.seq)) AS shape_seq, min({_NEAR}) AS distance_m FROM labelled p JOIN tracks h ON h.shape = p.shape GROUP BY ALL),
matched AS (SELECT l.day, l.bus, l.idx, gps_id, ts, trip_num, shape, shape_seq, distance_m,
    CASE WHEN trip_problem <> 'NO_PROBLEM' THEN trip_problem WHEN distance_m > threshold_m THEN 'OUTLIER_POINT' ELSE 'NO_PROBLEM' END AS problem
  FROM labelled l LEFT JOIN located n ON n.day = l.day AND n.bus = l.bus AND n.idx = l.idx LEFT JOIN (SELECT shape, threshold_m FROM slines) USING (shape))"""
_ALL_TRIPS = (_GPS, _LINES, _TRACKS, _SLINES, _cand("slines"), _TAGS, _RUNS, _PAIRED, _chosen_sql("slines"), _CLIPPED, _MATCHED)


@query(
    "g06_matched_pings",
    _recursive(*_ALL_TRIPS, body="SELECT CAST(day AS VARCHAR) AS day, bus, idx, gps_id, trip_num, shape, shape_seq, distance_m, problem FROM matched"),
)
def _(t):
    matched, _ = match_trips(gps(t), checkpointed(tracks(t), "tracks"))
    out = matched.select("day", "bus", "idx", "gps_id", "trip_num", "shape", "shape_seq", "distance_m", "problem")
    return out.withColumn("day", F.col("day").cast("string"))


_LATEST = """SELECT bus, shape, k AS seq, max_by(event_id, (ts, event_id)) AS event_id FROM pings GROUP BY 1, 2, 3"""


@query("a03_latest_per_shape_point", B.sql(B.PINGS, body=_LATEST))
def _(t):
    rows = B.pings(t).select("bus", "shape", F.col("k").alias("seq"), "event_id", "ts")
    return M.latest_per_shape_point(rows, ["bus", "shape", "seq"], tie="event_id").drop("ts")


def _stops(t):
    return t.orders.select((F.col("o_custkey") % 12).alias("shape"), (F.col("o_orderkey") % 3000 + 1).alias("seq")).distinct()


_TRIP_STOPS = """stop_list AS (SELECT DISTINCT o_custkey % 12 AS shape, o_orderkey % 3000 + 1 AS seq FROM orders),
latest AS (SELECT m.day, m.bus, m.trip_num, m.shape, m.shape_seq AS seq, h.dist, epoch_us(m.ts) // 1000 AS at_ms, m.problem FROM matched m JOIN tracks h ON h.shape = m.shape AND h.seq = m.shape_seq
  QUALIFY row_number() OVER (PARTITION BY m.day, m.bus, m.trip_num, m.shape, m.shape_seq ORDER BY m.ts DESC, m.gps_id DESC) = 1),
on_trip AS (SELECT day, bus, trip_num, shape, seq, max(dist) AS dist, max(at_ms) AS at_ms, max(problem) AS problem, bool_or(is_stop) AS is_stop
  FROM (SELECT *, false AS is_stop FROM latest UNION ALL
    SELECT k.*, h.seq, h.dist, NULL, NULL, true FROM (SELECT DISTINCT day, bus, trip_num, shape FROM latest) k JOIN stop_list s ON s.shape = k.shape JOIN tracks h ON h.shape = s.shape AND h.seq = s.seq)
  GROUP BY ALL)"""
_VISITED = """around AS (SELECT *, last_value(CASE WHEN at_ms IS NOT NULL THEN {'d': dist, 't': at_ms} END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS p,
    first_value(CASE WHEN at_ms IS NOT NULL THEN {'d': dist, 't': at_ms} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM on_trip WINDOW w AS (PARTITION BY day, bus, trip_num, shape ORDER BY seq)),
timed AS (SELECT *, coalesce(at_ms, CASE WHEN n.d <> p.d THEN p.t + CAST(trunc((dist - p.d) * (n.t - p.t) / (n.d - p.d)) AS BIGINT) END) AS est_ms FROM around),
visited AS (SELECT day, bus, trip_num, shape, seq, dist, est_ms, CASE WHEN at_ms IS NULL THEN 'BETWEEN' ELSE problem END AS problem FROM timed WHERE is_stop AND est_ms IS NOT NULL)"""


@query(
    "j02_trips_shapes_stops",
    _recursive(*_ALL_TRIPS, _TRIP_STOPS, body="SELECT CAST(day AS VARCHAR) AS day, bus, trip_num, shape, seq, dist, at_ms, problem, is_stop FROM on_trip"),
)
def _(t):
    shapes = checkpointed(tracks(t), "tracks")
    matched, _ = match_trips(gps(t), shapes)
    latest = M.latest_per_shape_point(matched.where("shape_seq IS NOT NULL"))
    return M.trips_shapes_stops(latest, shapes, _stops(t)).withColumn("day", F.col("day").cast("string"))


@query(
    "w05_stop_visits",
    _recursive(*_ALL_TRIPS, _TRIP_STOPS, _VISITED, body="SELECT CAST(day AS VARCHAR) AS day, bus, trip_num, shape, seq, dist, problem, est_ms FROM visited"),
)
def _(t):
    shapes = checkpointed(tracks(t), "tracks")
    matched, _ = match_trips(gps(t), shapes)
    out = stop_visits(matched, shapes, _stops(t)).withColumns({"day": F.col("day").cast("string"), "est_ms": F.unix_millis("ts")})
    return out.drop("ts")


_NEXT = """paired AS (SELECT v.*, route, est_ms // 1000 AS s, lead(est_ms // 1000) OVER w AS s2, lead(bus) OVER w AS bus2 FROM visited v JOIN (SELECT DISTINCT shape, route FROM tracks) USING (shape)
  WINDOW w AS (PARTITION BY day, route, shape, seq ORDER BY est_ms, bus))"""


@query(
    "w02_labelled_visits",
    _recursive(
        *_ALL_TRIPS,
        _TRIP_STOPS,
        _VISITED,
        _NEXT,
        body=f"""SELECT CAST(day AS VARCHAR) AS day, route, shape, seq, bus, bus2 AS next_bus, {B.sql_minutes('s', 's2')} AS headway_min, {B.sql_minutes('s', 's2')} <= 5 AS bunched
        FROM paired WHERE s2 IS NOT NULL AND bus <> bus2""",
    ),
)
def _(t):
    shapes = checkpointed(tracks(t), "tracks")
    routes = shapes.select("shape", "route").distinct()
    out = labelled_visits(gps(t), shapes, _stops(t), routes).withColumn("day", F.col("day").cast("string"))
    return out.select("day", "route", "shape", "seq", "bus", F.col("sb.bus").alias("next_bus"), "headway_min", "bunched")
