"""Queries: aggregates, shares, histograms, confusion tables, timetable frequency, bunching."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.operators import bunching as BB
from busweave.operators import gtfs as G
from busweave.operators import profile as P
from busweave.plans import bindings as B
from busweave.plans.registry import query

# --- timetable ---------------------------------------------------------------------------------

_MEDIANS = """gaps AS (
  SELECT route, (arrival_s - prev + 86400) % 86400 AS gap
  FROM (SELECT *, lag(arrival_s) OVER (PARTITION BY route, service_id, stop ORDER BY arrival_s, trip_id) AS prev FROM timetable)
  WHERE prev IS NOT NULL AND arrival_s < 86400 AND prev < 86400),
medians AS (SELECT route, quantile_cont(gap, 0.5) AS median_s FROM gaps GROUP BY route),
city AS (SELECT quantile_cont(median_s, 0.5) AS city_median_s FROM medians)"""


def _medians(t):
    return G.route_headway_medians(B.timetable(t), ["route", "service_id", "stop"], tie=["trip_id"])


@query("a04_route_headway_medians", B.sql(B.TIMETABLE, _MEDIANS, body="SELECT * FROM medians, city"))
def _(t):
    return _medians(t)


@query(
    "a05_route_frequency",
    B.sql(
        B.TIMETABLE,
        _MEDIANS,
        body="""SELECT r.route, CASE WHEN median_s <= city_median_s THEN 'high' ELSE 'low' END AS frequency
        FROM (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS route FROM orders UNION SELECT 9) r
        LEFT JOIN medians m ON m.route = r.route CROSS JOIN city""",
    ),
)
def _(t):
    routes = B.timetable(t).select("route").distinct()
    extra = routes.agg(F.lit(9).alias("route"))
    return G.route_frequency(routes.unionByName(extra), _medians(t))


# GTFS tables from orders (trips), customers (stops), parts (routes) and line items (stop events).
_GTFS = """
g_trips AS (SELECT o_orderkey AS trip_id, o_custkey % 300 AS route_id, o_orderkey % 4 AS service_id, o_orderkey % 200 AS shape_id FROM orders),
g_stops AS (SELECT c_custkey AS stop_id, -25.0 - (c_custkey % 100) / 200.0::DOUBLE AS lat, -49.0 - c_acctbal / 25000.0::DOUBLE AS lon FROM customer),
g_routes AS (SELECT p_partkey AS route_id, 'R' || p_partkey AS route_code, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS frequency FROM part),
g_events AS (SELECT l_orderkey AS trip_id, l_partkey % (SELECT count(*) FROM customer) AS stop_id, l_linenumber AS stop_seq,
  CAST(floor(epoch(l_shipdate)) AS BIGINT) AS arrival, l_suppkey AS k2, l_partkey AS k1, l_quantity FROM lineitem)"""


def _gtfs(t):
    stops = t.customer.select(
        F.col("c_custkey").alias("stop_id"),
        (F.lit(-25.0) - (F.col("c_custkey") % 100) / F.lit(200.0)).alias("lat"),
        (F.lit(-49.0) - F.col("c_acctbal") / 25000.0).alias("lon"),
        F.col("c_custkey").alias("file_order"),
    )
    n_stops = t.customer.count()
    return {
        "trips": t.orders.select(
            F.col("o_orderkey").alias("trip_id"),
            (F.col("o_custkey") % 300).alias("route_id"),
            (F.col("o_orderkey") % 4).alias("service_id"),
            (F.col("o_orderkey") % 200).alias("shape_id"),
            F.col("o_orderkey").alias("file_order"),
        ),
        "stops": stops,
        "routes": t.part.select(
            F.col("p_partkey").alias("route_id"),
            F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("route_code"),
            F.when(F.col("p_size") > 25, "high").otherwise("low").alias("frequency"),
            F.col("p_partkey").alias("file_order"),
        ),
        "stop_times": t.lineitem.select(
            F.col("l_orderkey").alias("trip_id"),
            (F.col("l_partkey") % n_stops).alias("stop_id"),
            F.col("l_linenumber").alias("stop_seq"),
            F.col("l_shipdate").cast("long").alias("arrival"),
            F.col("l_shipdate").cast("long").alias("departure"),
        ),
        "shapes": B.shapes(t).withColumnRenamed("shape", "shape_id"),
    }


_ON_SHAPE = f"""pairs AS (SELECT DISTINCT e.stop_id, tr.shape_id, s.lat, s.lon FROM g_events e
  JOIN g_trips tr USING (trip_id) JOIN g_stops s ON s.stop_id = e.stop_id),
on_shape AS (SELECT p.stop_id, p.shape_id, arg_min(h.seq, (round({B.sql_haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')}, 3), h.seq)) AS shape_seq,
  min(round({B.sql_haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')}, 3)) AS distance_m
  FROM pairs p JOIN shapes h ON h.shape = p.shape_id GROUP BY ALL)"""


@query("j04_nearest_for_stop", B.sql(B.SHAPES, _GTFS, _ON_SHAPE, body="SELECT * FROM on_shape"))
def _(t):
    g = _gtfs(t)
    pairs = (
        g["stop_times"].join(g["trips"], "trip_id").join(g["stops"].drop("file_order"), "stop_id")
        .select("stop_id", "shape_id", "lat", "lon").distinct()
    )
    return G.nearest_for_stop(pairs, g["shapes"]).select("stop_id", "shape_id", "shape_seq", "distance_m")


@query(
    "j05_stop_times_with_shapes",
    B.sql(
        B.SHAPES,
        _GTFS,
        _ON_SHAPE,
        body="""SELECT tr.service_id, e.arrival, e.arrival AS departure, e.stop_id, e.stop_seq, s.lat, s.lon,
        coalesce(r.route_code, '-') AS route, tr.shape_id, o.shape_seq, e.trip_id
        FROM g_events e JOIN g_trips tr USING (trip_id) JOIN g_stops s ON s.stop_id = e.stop_id
        LEFT JOIN g_routes r ON r.route_id = tr.route_id JOIN on_shape o ON o.stop_id = e.stop_id AND o.shape_id = tr.shape_id""",
    ),
)
def _(t):
    return G.stop_times_with_shapes(_gtfs(t))


@query(
    "j06_shapes_with_routes",
    B.sql(
        B.SHAPES,
        _GTFS,
        body="""SELECT coalesce(r.route_code, '-') AS route, h.shape AS shape_id, h.lat, h.lon, h.seq, h.dist * 1000 AS dist, coalesce(r.frequency, '-') AS frequency
        FROM shapes h LEFT JOIN (SELECT shape_id, arg_min(route_id, trip_id) AS route_id FROM g_trips GROUP BY shape_id) x ON x.shape_id = h.shape
        LEFT JOIN g_routes r ON r.route_id = x.route_id""",
    ),
)
def _(t):
    return G.shapes_with_routes(_gtfs(t), unit_km=True)


# --- shares ------------------------------------------------------------------------------------

_TRIPS = """v AS (SELECT *, CAST(ts AS DATE) AS date, (s // 21600) % 4 AS trip, CAST(hour(ts) AS INTEGER) AS hour FROM labelled)"""


def _v(t):
    return B.labelled(t).withColumns(
        {"date": F.to_date("ts"), "trip": F.expr("(s div 21600) % 4"), "hour": F.hour("ts")}
    )


def _share_sql(keys: str, out: str | None = None) -> str:
    trip = ", ".join(dict.fromkeys([*keys.split(", "), "date", "route", "bus", "trip"]))
    return B.sql(
        B.VISITS,
        B.LABELLED,
        _TRIPS,
        f"trips AS (SELECT {trip}, max(bunched) AS has_bunching FROM v GROUP BY ALL)",
        f"counts AS (SELECT {keys}, has_bunching, count(*) AS trips FROM trips GROUP BY ALL)",
        body=f"""SELECT {out or keys}, has_bunching, trips, round(trips / sum(trips) OVER (PARTITION BY {keys}), 9) AS share,
        round(CASE WHEN has_bunching THEN trips / sum(trips) OVER (PARTITION BY {keys}) ELSE 1 - trips / sum(trips) OVER (PARTITION BY {keys}) END, 9) AS hit_share FROM counts""",
    )


def _share(t, keys):
    out = BB.bunching_share(_v(t), keys)
    return out.withColumns({"share": F.round("share", 9), "hit_share": F.round("hit_share", 9)})


for _name, _keys in (
    ("a06_bunching_share_route", ["route"]),
    ("a07_bunching_share_bus", ["bus"]),
    ("a08_bunching_share_route_hour", ["route", "hour"]),
):
    query(_name, _share_sql(", ".join(_keys)))(lambda t, keys=_keys: _share(t, keys))

for _name, _keys in (
    ("a09_bunching_share_route_day", ["date", "route"]),
    ("a09_bunching_share_bus_day", ["date", "bus"]),
    ("a09_bunching_share_hour_day", ["date", "route", "hour"]),
):
    _cols = ", ".join(_keys)
    query(_name, _share_sql(_cols, "CAST(date AS VARCHAR) AS " + _cols))(
        lambda t, keys=_keys: _share(t, keys).withColumn("date", F.col("date").cast("string"))
    )


@query(
    "a10_routes_with_bunching",
    B.sql(
        B.VISITS,
        B.LABELLED,
        body="""SELECT 'route' AS "column", count(DISTINCT route) AS total, count(DISTINCT route) FILTER (headway_min <= 20) AS with_bunching FROM labelled
        UNION ALL SELECT 'bus', count(DISTINCT bus), count(DISTINCT bus) FILTER (headway_min <= 20) FROM labelled""",
    ),
)
def _(t):
    return BB.routes_with_bunching(B.labelled(t).withColumn("bunched", F.col("headway_min") <= 20))


@query(
    "a11_buses_per_route",
    B.sql(
        B.VISITS,
        body="""SELECT round(avg(m), 9) AS mean_buses_per_route FROM (SELECT route, avg(n) AS m FROM
        (SELECT route, CAST(ts AS DATE) AS d, count(DISTINCT bus) AS n FROM visits GROUP BY ALL) GROUP BY route)""",
    ),
)
def _(t):
    out = P.buses_per_route(B.visits(t).withColumn("day", F.to_date("ts")))
    return out.select(F.round("mean_buses_per_route", 9).alias("mean_buses_per_route"))


@query(
    "a12_coverage",
    """SELECT round(avg(CAST(event_type <> 'view' AS INTEGER)), 9) AS coverage FROM events""",
)
def _(t):
    return P.coverage(t.events, "event_type", "view").select(F.round("coverage", 9).alias("coverage"))


@query(
    "a12_coverage_per_day",
    """SELECT d.day, coalesce(round(c, 9), 0) AS coverage FROM
    (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) d LEFT JOIN
    (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, avg(CAST(event_type <> 'view' AS INTEGER)) AS c FROM events GROUP BY 1) USING (day)""",
)
def _(t):
    dated = t.events.withColumn("day", F.to_date("ts").cast("string"))
    out = P.coverage(dated, "event_type", "view", "day", dated)
    return out.withColumn("coverage", F.round("coverage", 9))


for _name, _expr, _col in (
    ("a13_rate_per_bus", "bus", F),
    ("a13_rate_per_route", "route", F),
    ("a13_rate_per_hour", "CAST(hour(ts) AS INTEGER)", F),
):
    _alias = _name.rsplit("_", 1)[1]
    query(
        _name,
        B.sql(B.VISITS, B.LABELLED, body=f"SELECT {_expr} AS {_alias}, round(avg(CAST(bunched AS INTEGER)), 9) AS rate FROM labelled GROUP BY 1"),
    )(
        lambda t, by=_alias: P.rate_by(B.labelled(t).withColumn("hour", F.hour("ts")), "bunched", [by]).withColumn(
            "rate", F.round("rate", 9)
        )
    )

_RATES = "rates AS (SELECT bus, avg(CAST(bunched AS INTEGER)) AS rate FROM labelled GROUP BY bus)"


@query(
    "a13_mean_and_median_rate",
    B.sql(B.VISITS, B.LABELLED, _RATES, body="SELECT round(avg(rate), 9) AS mean_rate, round(quantile_cont(rate, 0.5), 9) AS median_rate FROM rates"),
)
def _(t):
    out = P.mean_rate(B.labelled(t), "bunched", ["bus"])
    return out.select(F.round("mean_rate", 9).alias("mean_rate"), F.round("median_rate", 9).alias("median_rate"))


@query(
    "a14_argmax_group",
    B.sql(
        B.VISITS,
        B.LABELLED,
        body="SELECT bus, round(rate, 9) AS rate FROM (SELECT bus, avg(CAST(bunched AS INTEGER)) AS rate FROM labelled GROUP BY bus) ORDER BY rate DESC, bus LIMIT 1",
    ),
)
def _(t):
    rates = P.rate_by(B.labelled(t), "bunched", ["bus"])
    return P.argmax_group(rates, "bus", "rate").withColumn("rate", F.round("rate", 9))


_BY_TRIP = "trips AS (SELECT date, trip, bus, max(bunched) AS hit FROM v GROUP BY ALL)"


@query(
    "a15_trip_hit_share",
    B.sql(B.VISITS, B.LABELLED, _TRIPS, _BY_TRIP, body="SELECT CAST(date AS VARCHAR) AS date, count(*) AS trips, round(avg(CAST(hit AS INTEGER)), 9) AS share FROM trips GROUP BY 1"),
)
def _(t):
    out = P.trip_hit_share(_v(t), "bunched", ["date", "trip", "bus"], ["date"])
    return out.select(F.col("date").cast("string").alias("date"), "trips", F.round("share", 9).alias("share"))


@query(
    "a15_trip_hit_share_all",
    B.sql(B.VISITS, B.LABELLED, _TRIPS, _BY_TRIP, body="SELECT count(*) AS trips, round(avg(CAST(hit AS INTEGER)), 9) AS share FROM trips"),
)
def _(t):
    return P.trip_hit_share(_v(t), "bunched", ["date", "trip", "bus"]).withColumn("share", F.round("share", 9))


@query(
    "a16_weekday_share",
    B.sql(B.VISITS, B.LABELLED, body="SELECT dayname(ts) AS weekday, count(*) AS hits, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM labelled WHERE bunched GROUP BY 1"),
)
def _(t):
    return P.weekday_share(B.labelled(t), "bunched").withColumn("share", F.round("share", 9))


@query(
    "a17_distinct_counts",
    """SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_distinct FROM lineitem UNION ALL
    SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""",
)
def _(t):
    return P.distinct_counts(t.lineitem, ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])


@query(
    "a18_histogram",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT CAST(bin AS INTEGER) AS bin, n, round(lo + bin * ((hi - lo) / 100), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 100), 4) AS high
    FROM (SELECT least(99, floor((l_extendedprice - lo) / (hi - lo) * 100)) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM lineitem, b GROUP BY 1)""",
)
def _(t):
    out = P.histogram(t.lineitem, "l_extendedprice", 100)
    return out.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(
    "a19_null_audit",
    """SELECT 'l_tax' AS "column", count(*) FILTER (l_tax = 0) AS nulls, bool_or(l_tax = 0) AS any_null FROM lineitem
    UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity = 7), bool_or(l_quantity = 7) FROM lineitem
    UNION ALL SELECT 'l_partkey', 0, false""",
)
def _(t):
    holes = t.lineitem.select(
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"), F.nullif(F.col("l_quantity"), F.lit(7.0)).alias("l_quantity"), "l_partkey"
    )
    return P.null_audit(holes)


@query("a20_class_share", "SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 1")
def _(t):
    return P.class_share(t.lineitem, "l_returnflag").withColumn("share", F.round("share", 9))


@query(
    "a21_daily_totals",
    """SELECT CAST(d AS VARCHAR) AS day, coalesce(q, 0) AS value FROM
    (SELECT CAST(unnest(generate_series(min(e), max(e), INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT CAST(ts AS DATE) + CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) AS INTEGER) AS e FROM events))
    LEFT JOIN (SELECT CAST(ts AS DATE) + CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) AS INTEGER) AS d, round(sum(value), 4) AS q FROM events GROUP BY 1) USING (d)""",
)
def _(t):
    # A day is put in after every third one, so that there are days without rows.
    since = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    spread = t.events.withColumn("ts", F.date_add(F.to_date("ts"), F.floor(since / 3).cast("int")).cast("timestamp"))
    out = P.daily_totals(spread, "ts", ["value"])
    return out.select(F.col("day").cast("string").alias("day"), F.round("value", 4).alias("value"))


@query(
    "a25_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) FILTER ({c} IS NULL) AS nulls, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high,
        round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS deviation FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    ),
)
def _(t):
    out = P.profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
    return out.withColumns({"mean": F.round("mean", 5), "deviation": F.round("deviation", 5)})


# --- predictions -------------------------------------------------------------------------------


@query("a23_confusion", B.sql(B.PREDICTIONS, body="SELECT label, rf, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM predictions GROUP BY 1, 2"))
def _(t):
    return P.confusion(B.predictions(t), "label", "rf").withColumn("share", F.round("share", 9))


@query(
    "a24_error_coverage",
    B.sql(
        B.PREDICTIONS,
        body="""SELECT 'bus' AS "column", count(DISTINCT bus) AS n_all, count(DISTINCT bus) FILTER (cat = 0 AND label = 1 AND predicted > 60) AS n_error FROM predictions
        UNION ALL SELECT 'route', count(DISTINCT route), count(DISTINCT route) FILTER (cat = 0 AND label = 1 AND predicted > 60) FROM predictions""",
    ),
)
def _(t):
    return P.error_coverage(B.predictions(t), F.expr("cat = 0 AND label = 1 AND predicted > 60"), ["bus", "route"])


@query(
    "a26_confusion_matrix",
    """SELECT l_returnflag, count(*) FILTER (p = 'A') AS "pred_A", count(*) FILTER (p = 'N') AS "pred_N", count(*) FILTER (p = 'R') AS "pred_R"
    FROM (SELECT l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS p FROM lineitem) GROUP BY 1""",
)
def _(t):
    return P.confusion_matrix(_flags(t), "l_returnflag", "p", ["A", "N", "R"])


def _flags(t):
    guess = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_linenumber") % 3 + 1)
    return t.lineitem.select("l_returnflag", guess.alias("p"))


_FLAGS = "flags AS (SELECT l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS p FROM lineitem)"


@query(
    "a26_micro_average",
    B.sql(_FLAGS, body="""SELECT round(count(*) FILTER (l_returnflag = p AND p IN ('A', 'R')) / count(*) FILTER (p IN ('A', 'R')), 9) AS precision,
    round(count(*) FILTER (l_returnflag = p AND p IN ('A', 'R')) / count(*) FILTER (l_returnflag IN ('A', 'R')), 9) AS recall FROM flags"""),
)
def _(t):
    out = P.micro_average(_flags(t), "l_returnflag", "p", ["A", "R"])
    return out.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "m24_class_report",
    B.sql(
        _FLAGS,
        """per AS (SELECT c AS cls, count(*) FILTER (l_returnflag = c) AS support, count(*) FILTER (p = c) AS predicted,
           count(*) FILTER (p = c AND l_returnflag = c) AS tp FROM flags, (SELECT unnest(['A', 'N', 'R']) AS c) GROUP BY c)""",
        body="""SELECT cls, support, round(tp / predicted, 9) AS precision, round(tp / support, 9) AS recall, round(2 * tp / (support + predicted), 9) AS f1 FROM per""",
    ),
)
def _(t):
    out = P.class_report(_flags(t), "l_returnflag", "p")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "a27_residual_histogram",
    B.sql(
        B.PREDICTIONS,
        "r AS (SELECT actual - predicted AS e FROM predictions)",
        "b AS (SELECT min(e) AS lo, max(e) AS hi FROM r)",
        body="""SELECT CAST(least(9, floor((e - lo) / (hi - lo) * 10)) AS INTEGER) AS bin, count(*) AS n FROM r, b GROUP BY 1""",
    ),
)
def _(t):
    return P.residual_histogram(B.predictions(t), "actual", "predicted", 10).select("bin", "n")


@query("a28_count_by", B.sql(B.PREDICTIONS, body="SELECT route, label, count(*) AS n FROM predictions GROUP BY 1, 2"))
def _(t):
    return P.count_by(B.predictions(t), ["route", "label"])


@query("m15_majority_vote", B.sql(B.PREDICTIONS, body="SELECT row_id, CAST(rf + xgb + cat >= 2 AS INTEGER) AS vote FROM predictions"))
def _(t):
    return P.majority_vote(B.predictions(t), ["rf", "xgb", "cat"]).select("row_id", "vote")




@query(
    "m15_majority_vote_steps",
    B.sql(
        B.PREDICTIONS,
        body="SELECT row_id, "
        + ", ".join(
            f"CAST(rf + xgb + (cat + {k}) % 2 >= 2 AS INTEGER) AS vote_{k}" for k in range(11)
        )
        + " FROM predictions",
    ),
)
def _(t):
    out = B.predictions(t)
    for k in range(11):
        out = out.withColumn(f"c_{k}", (F.col("cat") + k) % 2)
        out = P.majority_vote(out, ["rf", "xgb", f"c_{k}"], f"vote_{k}")
    return out.select("row_id", *[f"vote_{k}" for k in range(11)])


@query(
    "m15_majority_vote_classes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS vote
    FROM (SELECT *, l_partkey % 3 AS a, l_suppkey % 3 AS b, l_orderkey % 3 AS c FROM lineitem)""",
)
def _(t):
    rows = t.lineitem.withColumns({"a": F.col("l_partkey") % 3, "b": F.col("l_suppkey") % 3, "c": F.col("l_orderkey") % 3})
    return P.majority_vote(rows, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "vote")


@query(
    "m17_error_weights",
    B.sql(B.PREDICTIONS, body="SELECT row_id, CAST(CASE WHEN label = rf THEN 0.1 WHEN label = 1 THEN 0.5 ELSE 0.4 END AS DOUBLE) AS weight FROM predictions"),
)
def _(t):
    return P.error_weights(B.predictions(t), "label", "rf").select("row_id", "weight")


@query(
    "m20_headway_to_bunching",
    B.sql(B.PREDICTIONS, body="SELECT row_id, predicted <= actual AS pred_bunched, CAST(predicted >= 20 AS INTEGER) AS pred_label FROM predictions"),
)
def _(t):
    out = P.headway_to_bunching(B.predictions(t), "predicted", "actual")
    return P.score_to_label(out, "predicted", 20).select("row_id", "pred_bunched", "pred_label")


@query(
    "m21_class_metrics",
    B.sql(
        B.PREDICTIONS,
        "c AS (SELECT count(*) FILTER (label = 1 AND cat = 1) AS tp, count(*) FILTER (label = 0 AND cat = 1) AS fp, count(*) FILTER (label = 1 AND cat = 0) AS fn, count(*) FILTER (label = 0 AND cat = 0) AS tn FROM predictions)",
        body="SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c",
    ),
)
def _(t):
    out = P.class_metrics(B.predictions(t), "label", "cat")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "m10_f_beta",
    B.sql(
        B.PREDICTIONS,
        body="""SELECT round(1.25::DOUBLE * tp / (1.25::DOUBLE * tp + 0.25::DOUBLE * fn + fp), 9) AS f_beta FROM (SELECT count(*) FILTER (label = 1 AND cat = 1) AS tp,
        count(*) FILTER (label = 0 AND cat = 1) AS fp, count(*) FILTER (label = 1 AND cat = 0) AS fn FROM predictions)""",
    ),
)
def _(t):
    return P.f_beta(B.predictions(t), "label", "cat", 0.5).select(F.round("f_beta", 9).alias("f_beta"))


@query(
    "m21_regression_metrics",
    B.sql(
        B.PREDICTIONS,
        body="""SELECT round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse, round(avg(abs(predicted - actual)), 6) AS mae,
        round(1 - sum(pow(predicted - actual, 2)) / (var_pop(actual) * count(*)), 6) AS r2 FROM predictions""",
    ),
)
def _(t):
    out = P.regression_metrics(B.predictions(t), "actual", "predicted")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "m22_rmse_by_horizon",
    B.sql(
        B.PREDICTIONS,
        body="""SELECT horizon, round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse FROM predictions GROUP BY horizon
        UNION ALL SELECT 0, round(sqrt(avg(pow(predicted - actual, 2))), 6) FROM predictions""",
    ),
)
def _(t):
    return P.rmse_by_horizon(B.predictions(t)).withColumn("rmse", F.round("rmse", 6))


@query(
    "m25_mean_probability",
    """SELECT vec_id, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS prediction, round(list_max(m), 5) AS best FROM
    (SELECT vec_id, [CAST(embedding[i] AS DOUBLE) / 3 + CAST(embedding[i + 20] AS DOUBLE) / 3 + CAST(embedding[i + 40] AS DOUBLE) / 3 for i in range(1, 21)] AS m FROM embeddings)""",
)
def _(t):
    parts = {f"p{k}": F.slice(F.col("embedding").cast("array<double>"), 1 + 20 * k, 20) for k in range(3)}
    out = P.mean_probability(t.embeddings.withColumns(parts), list(parts))
    return out.select("vec_id", "prediction", F.round(F.array_max("probability"), 5).alias("best"))


# --- bunching pairs ----------------------------------------------------------------------------

_DENSE = """dense AS (SELECT event_id AS id, CAST(ts AS DATE) AS date, event_type AS route, user_id % 3 AS shape, user_id AS bus, ts,
  -25.0 - user_id / 20000.0::DOUBLE AS lat, -49.0 - value / 200000.0::DOUBLE AS lon, epoch(ts) AS at, substr(strftime(ts, '%H%M'), 1, 3) AS tag FROM events)"""


def _dense(t):
    return t.events.select(
        F.col("event_id").alias("id"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("route"),
        (F.col("user_id") % 3).alias("shape"),
        F.col("user_id").alias("bus"),
        "ts",
        (F.lit(-25.0) - F.col("user_id") / 20000.0).alias("lat"),
        (F.lit(-49.0) - F.col("value") / 200000.0).alias("lon"),
    )


_PAIRS = f"""near AS (SELECT a.id AS id_a, b.bus AS bus_b, arg_min(b.id, (abs(a.at - b.at), b.id)) AS id_b, min(abs(a.at - b.at)) AS gap
  FROM dense a JOIN dense b ON a.date = b.date AND a.route = b.route AND a.shape = b.shape AND a.tag = b.tag AND a.bus <> b.bus GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b, round({B.sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS distance_m, gap
  FROM near JOIN dense a ON a.id = id_a JOIN dense b ON b.id = id_b WHERE gap < 300 AND round({B.sql_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) < 500)"""


@query("j13_bunching_pairs", B.sql(_DENSE, _PAIRS, body="SELECT id_a, id_b, distance_m, round(gap, 3) AS gap_s FROM pairs"))
def _(t):
    return BB.bunching_pairs(_dense(t), distance_m=500, gap_s=300).withColumn("gap_s", F.round("gap_s", 3))


@query(
    "g07_bunching_lists",
    B.sql(
        _DENSE,
        _PAIRS,
        "both_ways AS (SELECT id_a AS i, id_b AS j FROM pairs UNION SELECT id_b, id_a FROM pairs UNION SELECT id_a, id_a FROM pairs UNION SELECT id_b, id_b FROM pairs)",
        body="""SELECT id, coalesce(x, '') AS bunched_with FROM dense LEFT JOIN
        (SELECT i, string_agg(CAST(j AS VARCHAR), '-' ORDER BY j) || '-' AS x FROM both_ways GROUP BY i) ON i = id""",
    ),
)
def _(t):
    rows = _dense(t)
    return BB.bunching_lists(rows, BB.bunching_pairs(rows, distance_m=500, gap_s=300)).select("id", "bunched_with")
