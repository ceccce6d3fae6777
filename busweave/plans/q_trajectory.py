"""Queries: trajectories, time series and look-ahead labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.functions.geo import haversine_m
from busweave.operators import features as FE
from busweave.operators import series as S
from busweave.operators import trajectory as T
from busweave.operators.ordered import blocks_of, hours
from busweave.plans import bindings as B
from busweave.plans.registry import query
from busweave.session import checkpointed

# Pings are hours apart in these tables: pauses and limits are scaled to give segments and outliers.
GAP_S, MAX_POINTS = 200000, 40
SPEEDS = {0: 0.9, 1: 1.1, 2: 0.6, 3: 2.0, 4: 1.5}
ACCELS = {0: 3e-5, 1: 5e-5, 2: 1e-4, 3: 1e-4, 4: 2e-5}

_POINTS = """points AS (SELECT bus % 30 AS user, event_id AS point_id, ts, epoch(ts) AS es, lat, lon, CAST((s // 777600) % 5 AS INTEGER) AS mode FROM pings)"""


def points(t):
    return B.pings(t).select(
        (F.col("bus") % 30).alias("user"), F.col("event_id").alias("point_id"), "ts", "lat", "lon",
        (F.expr("s div 777600") % 5).cast("int").alias("mode"),
    )


@query(
    "j14_label_intervals",
    """SELECT p.event_id, q.event_id AS label_id FROM events p JOIN events q ON q.event_type = 'purchase' AND q.user_id = p.user_id
    AND epoch(p.ts) BETWEEN epoch(q.ts) - 1 AND epoch(q.ts) + 14401""",
)
def _(t):
    labels = t.events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("user"), F.col("event_id").alias("label_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("end")
    )
    rows = t.events.select(F.col("user_id").alias("user"), "event_id", "ts")
    return T.label_intervals(rows, labels).select("event_id", "label_id")


@query(
    "w10_step_kinematics",
    B.sql(
        B.PINGS,
        _POINTS,
        f"""near AS (SELECT *, lead(es) OVER w AS es2, {B.sql_haversine('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS d FROM points WINDOW w AS (PARTITION BY user ORDER BY ts, point_id))""",
        "stepped AS (SELECT *, CASE WHEN es2 - es = 0 THEN 0.1 ELSE es2 - es END AS dt FROM near)",
        body="""SELECT point_id, round(coalesce(dt, 3.0), 3) AS delta_s, round(coalesce(d / dt, lag(d / dt) OVER (PARTITION BY user ORDER BY ts, point_id)), 6) AS speed FROM stepped""",
    ),
)
def _(t):
    out = T.step_kinematics(points(t), metric=haversine_m)
    return out.select("point_id", F.round("delta_s", 3).alias("delta_s"), F.round("speed", 6).alias("speed"))


@query("w10_step_kinematics_geodesic")
def _(t):
    out = T.step_kinematics(points(t))
    return out.select("point_id", F.round("delta_s", 3).alias("delta_s"), F.round("speed", 6).alias("speed"))


_SEG = f"""starts AS (SELECT *, coalesce(mode <> lag(mode) OVER w OR es - lag(es) OVER w > {GAP_S}, true) AS st FROM points WINDOW w AS (PARTITION BY user ORDER BY ts, point_id)),
runs AS (SELECT *, CAST(sum(CAST(st AS INTEGER)) OVER (PARTITION BY user ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM starts),
placed AS (SELECT *, row_number() OVER (PARTITION BY user, run ORDER BY ts, point_id) - 1 AS pos FROM runs),
segs AS (SELECT * FROM (SELECT user, point_id, ts, es, lat, lon, mode, run || '-' || (pos // {MAX_POINTS}) AS segment, pos % {MAX_POINTS} AS seg_pos,
  count(*) OVER (PARTITION BY user, run, pos // {MAX_POINTS}) AS n FROM placed) WHERE n >= 10)"""


def segments(t):
    return T.segment_trips(points(t), GAP_S, MAX_POINTS)


@query("w09_segment_trips", B.sql(B.PINGS, _POINTS, _SEG, body="SELECT point_id, segment, seg_pos FROM segs"))
def _(t):
    return segments(t).select("point_id", "segment", "seg_pos")


def _limit_sql(limits: dict) -> str:
    return "CASE mode " + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in limits.items()) + " END"


_BEARING = """((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360.0) % 360.0)"""
_W = "(PARTITION BY user, segment ORDER BY seg_pos)"
_STEPS = f"""st0 AS (SELECT *, lead(es) OVER w AS es2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM segs WINDOW w AS {_W}),
st1 AS (SELECT *, es2 - es + 1 AS dt, {B.sql_haversine('lat', 'lon', 'lat2', 'lon2')} AS d, {_BEARING} AS b, es2 IS NULL AS lst FROM st0),
st2 AS (SELECT *, count(*) FILTER (NOT lst) OVER (PARTITION BY user, segment) AS steps FROM st1 WHERE lst OR d / dt <= {_limit_sql(SPEEDS)}),
sp AS (SELECT user, segment, seg_pos, point_id, mode, dt, CASE WHEN lst THEN lag(d) OVER w ELSE d END AS d, CASE WHEN lst THEN lag(d / dt) OVER w ELSE d / dt END AS v,
  CASE WHEN lst THEN lag(b) OVER w ELSE b END AS b FROM st2 WHERE steps >= 10 WINDOW w AS {_W})"""
_ACC = f"""ac0 AS (SELECT *, lead(seg_pos) OVER w IS NULL AS lst, (lead(v) OVER w - v) / dt AS a FROM sp WINDOW w AS {_W}),
ac1 AS (SELECT *, count(*) FILTER (NOT lst) OVER (PARTITION BY user, segment) AS steps FROM ac0 WHERE lst OR abs(a) <= {_limit_sql(ACCELS)}),
ac2 AS (SELECT user, segment, seg_pos, point_id, mode, dt, d, v, b, lst, CASE WHEN lst THEN lag(a) OVER w ELSE a END AS a FROM ac1 WHERE steps >= 10 WINDOW w AS {_W}),
jk0 AS (SELECT *, (lead(a) OVER w - a) / dt AS j FROM ac2 WINDOW w AS {_W}),
jk AS (SELECT * REPLACE (CASE WHEN lst THEN lag(j) OVER w ELSE j END AS j) FROM jk0 WINDOW w AS {_W})"""
_RATE = f"""br0 AS (SELECT *, abs(lead(b) OVER w - b) AS br, CASE WHEN lead(v) OVER w IS NULL THEN NULL WHEN v = 0 THEN 1 ELSE abs(lead(v) OVER w - v) / v END AS vc FROM jk WINDOW w AS {_W}),
br AS (SELECT * REPLACE (CASE WHEN lst THEN lag(br) OVER w ELSE br END AS br, CASE WHEN lst THEN lag(vc) OVER w ELSE vc END AS vc) FROM br0 WINDOW w AS {_W})"""
_CHAIN = (B.PINGS, _POINTS, _SEG, _STEPS)


def _speed(t):
    return T.speed_filter(segments(t), SPEEDS, haversine_m)


def _full(t):
    return T.bearing_rate(T.acceleration_jerk(_speed(t), ACCELS))


@query(
    "w11_speed_filter",
    B.sql(*_CHAIN, body="SELECT point_id, segment, round(d, 3) AS distance_m, round(dt, 3) AS delta_s, round(v, 6) AS speed, round(b, 5) AS bearing FROM sp"),
)
def _(t):
    out = _speed(t)
    return out.select(
        "point_id", "segment", F.round("distance_m", 3).alias("distance_m"), F.round("delta_s", 3).alias("delta_s"),
        F.round("speed", 6).alias("speed"), F.round("bearing", 5).alias("bearing"),
    )


@query(
    "w12_acceleration_jerk",
    B.sql(*_CHAIN, _ACC, body="SELECT point_id, segment, round(a * 1e6, 4) AS acceleration, round(j * 1e9, 4) AS jerk FROM jk"),
)
def _(t):
    out = T.acceleration_jerk(_speed(t), ACCELS)
    return out.select(
        "point_id", "segment", F.round(F.col("acceleration") * 1e6, 4).alias("acceleration"), F.round(F.col("jerk") * 1e9, 4).alias("jerk")
    )


@query(
    "w13_bearing_rate",
    B.sql(*_CHAIN, _ACC, _RATE, body="SELECT point_id, segment, round(br, 5) AS bearing_rate, round(vc, 5) AS velocity_change FROM br"),
)
def _(t):
    return _full(t).select("point_id", "segment", F.round("bearing_rate", 5).alias("bearing_rate"), F.round("velocity_change", 5).alias("velocity_change"))


_TOP = ", ".join(
    f"round(list_sort(list({c}), 'DESC')[{i}] * {m}, 4) AS {n}{i}" for c, n, m in (("v", "max_v", 1), ("a", "max_a", "1e6")) for i in (1, 2, 3)
)


@query(
    "a22_segment_features",
    B.sql(
        *_CHAIN,
        _ACC,
        _RATE,
        body=f"""SELECT user, segment, round(sum(d), 3) AS distance, round(sum(d) / sum(dt), 6) AS average_velocity, round(avg(v), 6) AS mean_velocity,
        round(var_pop(v), 6) AS velocity_variance, {_TOP}, round(1e6 * count(*) FILTER (br > 19) / sum(d), 4) AS heading_change_rate,
        round(1e6 * count(*) FILTER (v < 3.4) / sum(d), 4) AS stop_rate, round(1e6 * count(*) FILTER (vc > 0.26) / sum(d), 4) AS velocity_change_rate, any_value(mode) AS label
        FROM br GROUP BY user, segment""",
    ),
)
def _(t):
    out = T.segment_features(_full(t))
    scale = {"distance": (1, 3), "average_velocity": (1, 6), "mean_velocity": (1, 6), "velocity_variance": (1, 6)}
    scale |= {f"max_v{i}": (1, 4) for i in (1, 2, 3)} | {f"max_a{i}": (1e6, 4) for i in (1, 2, 3)}
    scale |= {c: (1e6, 4) for c in ("heading_change_rate", "stop_rate", "velocity_change_rate")}
    return out.withColumns({c: F.round(F.col(c) * m, d) for c, (m, d) in scale.items()})


@query(
    "f30_pad_channels",
    B.sql(
        *_CHAIN,
        _ACC,
        _RATE,
        body="""SELECT user, segment, CAST(count(*) AS INTEGER) AS points, CAST(200 AS INTEGER) AS length, round(sum(v), 4) AS speed_sum,
        round(arg_min(v, seg_pos), 5) AS first_speed, round(arg_max(br, seg_pos), 5) AS last_rate, any_value(mode) AS label FROM br GROUP BY 1, 2 HAVING sum(d) > 0""",
    ),
)
def _(t):
    out = T.pad_channels(_full(t), ["speed", "acceleration", "jerk", "bearing_rate"])
    c = F.col("channels")
    return out.select(
        "user", "segment", "points", F.size(c).alias("length"),
        F.round(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v[0]), 4).alias("speed_sum"),
        F.round(c[0][0], 5).alias("first_speed"),
        F.round(F.get(c, F.col("points") - 1)[3], 5).alias("last_rate"),
        "label",
    )


# --- series ------------------------------------------------------------------------------------

_Y = "ys[{j}]"


def _savgol_sql() -> str:
    terms = []
    for k, c in zip(range(-4, 5), S.SAVGOL_9_3):
        j = f"(i + {k})"
        terms.append(
            f"({c}) * (CASE WHEN {j} < 1 THEN ys[1] - abs(ys[2 - {j}] - ys[1]) WHEN {j} > n THEN ys[n] + abs(ys[2 * n - {j}] - ys[n]) ELSE ys[{j}] END)"
        )
    return f"""SELECT shape, i AS seq, round(({' + '.join(terms)}) / 231.0, 6) AS smooth FROM
    (SELECT shape, ys, len(ys) AS n, unnest(range(1, len(ys) + 1)) AS i FROM
      (SELECT shape, list(lat + dist / 1000 ORDER BY seq) AS ys FROM shapes GROUP BY shape))"""


@query("w14_savgol", B.sql(B.SHAPES, body=_savgol_sql()))
def _(t):
    rows = checkpointed(B.shapes(t), "shapes").select("shape", "seq", (F.col("lat") + F.col("dist") / 1000).alias("y"))
    out = S.savgol(rows, ["shape"], ["seq"], blocks_of("seq", 1024), "y")
    return out.select("shape", "seq", F.round("smooth", 6).alias("smooth"))


@query(
    "w15_fill_from_previous_day",
    """SELECT event_id, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY CAST(floor(epoch(ts) / 60) AS BIGINT) % 1440 ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS value
    FROM (SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""",
)
def _(t):
    holes = t.events.select("event_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return S.fill_from_previous_day(holes, "ts", "value").select("event_id", "value")


@query(
    "w16_sliding_frame",
    """SELECT * FROM (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, """
    + ", ".join(f"lag(value, {7 - i + 1}) OVER w AS x_{i}" for i in range(1, 8))
    + """, value AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE x_1 IS NOT NULL""",
)
def _(t):
    out = S.sliding_frame(t.events, ["user_id"], ["ts"], hours("ts", 86400), "value", 7)
    return out.withColumn("moment", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")


@query(
    "w17_chunk_rows",
    """SELECT event_id, (row_number() OVER (ORDER BY ts) - 1) // 7 AS chunk FROM events""",
)
def _(t):
    return S.chunk_rows(t.events.select("event_id", "ts"), [], ["ts"], hours("ts"), 7).select("event_id", "chunk")


@query(
    "w07_label_ahead",
    B.sql(B.VISITS, B.LABELLED, body="SELECT event_id, lead(CAST(bunched AS INTEGER), 5) OVER (PARTITION BY route, stop ORDER BY ts) AS ahead FROM labelled"),
)
def _(t):
    rows = B.labelled(t).withColumn("flag", F.col("bunched").cast("int"))
    out = FE.label_ahead(rows, 5, ["route", "stop"], ["ts"], hours("ts", 86400), "flag")
    return out.select("event_id", "ahead")


@query(
    "w08_labels_ahead",
    B.sql(
        B.VISITS,
        B.LABELLED,
        body="SELECT event_id, "
        + ", ".join(f"coalesce(lead(CAST(bunched AS INTEGER), {k}) OVER w, 0) AS step_{k}" for k in range(1, 11))
        + " FROM labelled WINDOW w AS (PARTITION BY bus % 10, bus2 % 10 ORDER BY ts)",
    ),
)
def _(t):
    rows = B.labelled(t).withColumns({"bus": F.col("bus") % 10, "bus2": F.col("bus2") % 10, "flag": F.col("bunched").cast("int")})
    out = FE.labels_ahead(rows, 10, ["bus", "bus2"], ["ts"], hours("ts", 86400), "flag")
    return out.select("event_id", *[f"step_{k}" for k in range(1, 11)])
