"""Queries: headway, schedule, service day, bunching label."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.functions.times import seconds_of_day
from busweave.operators import headway as H
from busweave.plans import bindings as B
from busweave.plans.registry import query

_LEAD = f"""SELECT event_id, route, stop, bus, bus2 AS next_bus, s2 AS next_s, {B.sql_minutes('s', 's2')} AS headway_min
FROM (SELECT *, lead(s) OVER w AS s2, lead(bus) OVER w AS bus2,
             row_number() OVER w AS rn, count(*) OVER (PARTITION BY route, stop) AS n
      FROM visits WINDOW w AS (PARTITION BY route, stop ORDER BY ts, bus))
WHERE s2 IS NOT NULL AND bus <> bus2"""


def _headway(t, compat=False):
    out = H.next_bus_headway(B.visits(t), ["route", "stop"], carry=["s"], compat=compat)
    return out.select(
        "event_id", "route", "stop", "bus", F.col("sb.bus").alias("next_bus"), F.col("sb.s").alias("next_s"), "headway_min"
    )


@query("w01_next_bus_headway", B.sql(B.VISITS, body=_LEAD))
def _(t):
    return _headway(t)


@query("w01_next_bus_headway_compat", B.sql(B.VISITS, body=_LEAD + " AND rn <= n - 2"))
def _(t):
    return _headway(t, compat=True)


@query(
    "w02_label_bunching",
    B.sql(B.VISITS, body=f"SELECT *, CAST(5 AS BIGINT) AS threshold_min, headway_min <= 5 AS bunched FROM ({_LEAD})"),
)
def _(t):
    return H.label_bunching(_headway(t))


@query(
    "w01_next_bus_columns",
    B.sql(
        B.VISITS,
        body=f"SELECT event_id, route, stop, bus, s, route AS \"routeSB\", stop AS \"stopSB\", bus2 AS \"busSB\", s2 AS \"sSB\","
        f" {B.sql_minutes('s', 's2')} AS headway_min FROM (SELECT *, lead(s) OVER w AS s2, lead(bus) OVER w AS bus2"
        " FROM visits WINDOW w AS (PARTITION BY route, stop ORDER BY ts, bus)) WHERE s2 IS NOT NULL AND bus <> bus2",
    ),
)
def _(t):
    out = H.flatten_next(H.next_bus_headway(B.visits(t), ["route", "stop"], carry=["route", "stop", "bus", "s"]))
    return out.drop("ts", "tsSB", "value")


_SCHED = """sched AS (
  SELECT route, stop, service_id, arrival_s AS first_arr, second_arr,
         CAST(floor((second_arr - arrival_s) / 60) AS BIGINT) AS sched_min
  FROM (SELECT *, lead(arrival_s) OVER (PARTITION BY route, stop, service_id ORDER BY arrival_s, trip_id) AS second_arr,
               row_number() OVER (PARTITION BY route, stop, service_id ORDER BY arrival_s, trip_id) AS rn,
               count(*) OVER (PARTITION BY route, stop, service_id) AS n FROM timetable)
  WHERE second_arr IS NOT NULL)"""

_KEYS = ["route", "stop", "service_id"]


@query("w03_scheduled_headways", B.sql(B.TIMETABLE, _SCHED, body="SELECT * FROM sched"))
def _(t):
    return H.scheduled_headways(B.timetable(t), _KEYS, tie=["trip_id"])


@query(
    "w03_scheduled_headways_compat",
    B.sql(
        B.TIMETABLE,
        _SCHED.replace("WHERE second_arr IS NOT NULL", "WHERE second_arr IS NOT NULL AND (n = 2 OR rn < n - 1)"),
        body="SELECT * FROM sched",
    ),
)
def _(t):
    return H.scheduled_headways(B.timetable(t), _KEYS, tie=["trip_id"], compat=True)


@query(
    "w03_scheduled_headways_distinct",
    B.sql(
        """timetable AS (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS route, 0 AS trip_id,
           o_custkey % 10 AS stop, o_orderkey % 4 AS service_id,
           CAST(((o_orderkey * 37) % 86400) // 600 * 600 AS INTEGER) AS arrival_s FROM orders)""",
        _SCHED,
        body="SELECT * FROM sched",
    ),
)
def _(t):
    coarse = B.timetable(t).withColumn("arrival_s", F.expr("cast(arrival_s div 600 * 600 as int)"))
    return H.scheduled_headways(coarse, _KEYS, distinct=True)


def _pairs(t):
    p = H.next_bus_headway(B.visits(t), ["route", "stop"], carry=["ts"])
    return p.select(
        "event_id",
        B.route_number().alias("route"),
        "stop",
        (F.weekday("ts") % 4).cast("long").alias("service_id"),
        seconds_of_day(F.col("ts")).alias("t1_s"),
        seconds_of_day(F.col("sb.ts")).alias("t2_s"),
        "headway_min",
    )


_PAIRS = f"""pairs AS (
  SELECT event_id, {B.SQL_ROUTE_NUMBER} AS route, stop, CAST((isodow(ts) - 1) % 4 AS BIGINT) AS service_id,
         CAST(s % 86400 AS INTEGER) AS t1_s, CAST(s2 % 86400 AS INTEGER) AS t2_s, {B.sql_minutes('s', 's2')} AS headway_min
  FROM (SELECT *, lead(s) OVER w AS s2, lead(bus) OVER w AS bus2 FROM visits
        WINDOW w AS (PARTITION BY route, stop ORDER BY ts, bus))
  WHERE s2 IS NOT NULL AND bus <> bus2)"""

_LOOKUP = """looked AS (
  SELECT p.event_id, p.headway_min,
         (SELECT arg_min(sched_min, first_arr) FROM sched q WHERE q.route = p.route AND q.stop = p.stop
            AND q.service_id = p.service_id AND q.first_arr <= p.t1_s AND p.t1_s <= p.t2_s AND p.t2_s <= q.second_arr) AS sched_min
  FROM pairs p)"""


@query(
    "j11_scheduled_headway_for",
    B.sql(B.VISITS, B.TIMETABLE, _SCHED, _PAIRS, _LOOKUP, body="SELECT event_id, headway_min, sched_min FROM looked"),
)
def _(t):
    sched = H.scheduled_headways(B.timetable(t), _KEYS, tie=["trip_id"])
    out = H.scheduled_headway_for(_pairs(t), sched, "event_id", _KEYS, ids=t.events)
    return out.select("event_id", "headway_min", "sched_min")


@query(
    "w02_label_bunching_scheduled",
    B.sql(
        B.VISITS,
        B.TIMETABLE,
        _SCHED,
        _PAIRS,
        _LOOKUP,
        body="""SELECT event_id, headway_min, coalesce(CAST(floor(sched_min / 4) AS BIGINT), 5) AS threshold_min,
        headway_min <= coalesce(CAST(floor(sched_min / 4) AS BIGINT), 5) AS bunched FROM looked""",
    ),
)
def _(t):
    sched = H.scheduled_headways(B.timetable(t), _KEYS, tie=["trip_id"])
    out = H.label_bunching(H.scheduled_headway_for(_pairs(t), sched, "event_id", _KEYS, ids=t.events), scheduled="sched_min")
    return out.select("event_id", "headway_min", "threshold_min", "bunched")


_CALENDAR = """calendar AS (
  SELECT CAST(n_nationkey AS INTEGER) AS service_id, CAST(n_nationkey % 7 AS INTEGER) AS dow,
         DATE '2024-01-01' AS start_date, DATE '2024-01-05' + n_nationkey AS end_date FROM nation)"""


def _calendar(t):
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    return t.nation.select(
        F.col("n_nationkey").alias("service_id"),
        F.lit("2024-01-01").cast("date").alias("start_date"),
        F.date_add(F.lit("2024-01-05").cast("date"), F.col("n_nationkey")).alias("end_date"),
        *[(F.col("n_nationkey") % 7 == i).cast("int").alias(d) for i, d in enumerate(days)],
    )


@query(
    "j12_service_for_day",
    B.sql(
        _CALENDAR,
        body="""SELECT event_id, coalesce((SELECT min(service_id) FROM calendar c
          WHERE c.dow = isodow(e.ts) - 1 AND CAST(e.ts AS DATE) <= c.end_date), 1) AS service_id FROM events e""",
    ),
)
def _(t):
    return H.service_for_day(t.events, _calendar(t)).select("event_id", "service_id")
