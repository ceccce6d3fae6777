"""Domain views over the driver tables, each written once for Spark and once as SQL text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busweave.operators.ordered import blocks_of, over_slices, position, running_sum
from busweave.plans.registry import Tables


def sql(*views: str, body: str) -> str:
    """WITH clause from named views plus a query body."""
    return "WITH " + ",\n".join(views) + "\n" + body


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(pow(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - ({lon1})) / 2), 2))"
    )
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def sql_minutes(a: str, b: str) -> str:
    """Whole minutes between two epoch-second columns."""
    return f"CAST(trunc(({b} - {a}) / 60.0) AS BIGINT)"


# --- stop visits -------------------------------------------------------------------------------

VISITS = """visits AS (
  SELECT event_id, event_type AS route, user_id % 10 AS stop, user_id AS bus, ts,
         CAST(floor(epoch(ts)) AS BIGINT) AS s, value
  FROM events)"""


def visits(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.col("event_type").alias("route"),
        (F.col("user_id") % 10).alias("stop"),
        F.col("user_id").alias("bus"),
        "ts",
        F.col("ts").cast("long").alias("s"),
        "value",
    )


# Visits labelled with the next bus; 150 minutes gives both classes on these tables.
LABELLED = f"""labelled AS (
  SELECT *, {sql_minutes('s', 's2')} AS headway_min, {sql_minutes('s', 's2')} <= 150 AS bunched
  FROM (SELECT *, lead(s) OVER w AS s2, lead(bus) OVER w AS bus2 FROM visits
        WINDOW w AS (PARTITION BY route, stop ORDER BY ts, bus))
  WHERE s2 IS NOT NULL AND bus <> bus2)"""


def labelled(t: Tables) -> DataFrame:
    from busweave.operators.headway import label_bunching, next_bus_headway

    paired = next_bus_headway(visits(t), ["route", "stop"], carry=["s"])
    out = label_bunching(paired, default_threshold=150)
    return out.select(
        "event_id",
        "route",
        "stop",
        "bus",
        "ts",
        "s",
        "value",
        F.col("sb.s").alias("s2"),
        F.col("sb.bus").alias("bus2"),
        "headway_min",
        "bunched",
    )


# --- vehicle pings -----------------------------------------------------------------------------

PINGS = """pings AS (
  SELECT event_id, user_id AS bus, user_id % 200 AS shape, event_type AS route, ts,
         CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, value,
         -25.0 - CAST(regexp_extract(props, '[0-9]+') AS INTEGER) / 200.0::DOUBLE AS lat,
         -49.0 - value / 1000.0::DOUBLE AS lon
  FROM events)"""


def pings(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        "event_id",
        F.col("user_id").alias("bus"),
        (F.col("user_id") % 200).alias("shape"),
        F.col("event_type").alias("route"),
        "ts",
        F.col("ts").cast("long").alias("s"),
        k.alias("k"),
        "value",
        (F.lit(-25.0) - k / F.lit(200.0)).alias("lat"),
        (F.lit(-49.0) - F.col("value") / 1000.0).alias("lon"),
    )


# --- route shapes ------------------------------------------------------------------------------

SHAPE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]

SHAPES = """shapes AS (
  SELECT l_orderkey % 200 AS shape,
         row_number() OVER w AS seq,
         sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS dist,
         -25.0 - (l_partkey % 100) / 200.0::DOUBLE AS lat,
         -49.0 - (l_suppkey % 50) / 100.0::DOUBLE AS lon,
         CAST(floor(epoch(l_shipdate)) AS BIGINT) AS s, l_returnflag, l_linestatus
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey % 200
               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate))"""


def shapes(t: Tables) -> DataFrame:
    keyed = t.lineitem.withColumn("shape", F.col("l_orderkey") % 200)
    placed = over_slices(
        keyed, ["shape"], SHAPE_ORDER, blocks_of("l_orderkey", 4096), seq=position(), dist=running_sum(F.col("l_quantity"))
    )
    return placed.select(
        "shape",
        "seq",
        "dist",
        (F.lit(-25.0) - (F.col("l_partkey") % 100) / F.lit(200.0)).alias("lat"),
        (F.lit(-49.0) - (F.col("l_suppkey") % 50) / F.lit(100.0)).alias("lon"),
        F.col("l_shipdate").cast("long").alias("s"),
        "l_returnflag",
        "l_linestatus",
    )


# --- weather -----------------------------------------------------------------------------------

STATIONS = """stations AS (
  SELECT s_suppkey AS station, -25.0 - (s_suppkey % 100) / 200.0::DOUBLE AS lat,
         -49.0 - s_acctbal / 20000.0::DOUBLE AS lon FROM supplier)"""


def stations(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("station"),
        (F.lit(-25.0) - (F.col("s_suppkey") % 100) / F.lit(200.0)).alias("lat"),
        (F.lit(-49.0) - F.col("s_acctbal") / 20000.0).alias("lon"),
    )


READINGS = """readings AS (
  SELECT user_id % 100 AS station, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s, value AS precipitation
  FROM events WHERE event_type = 'signup')"""


def readings(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'signup'").select(
        (F.col("user_id") % 100).alias("station"), "ts", F.col("ts").cast("long").alias("s"), F.col("value").alias("precipitation")
    )


# --- timetable ---------------------------------------------------------------------------------

TIMETABLE = """timetable AS (
  SELECT o_orderkey AS trip_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS route,
         o_custkey % 10 AS stop, o_orderkey % 4 AS service_id,
         CAST((o_orderkey * 37) % 86400 AS INTEGER) AS arrival_s
  FROM orders)"""


def timetable(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("trip_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("route"),
        (F.col("o_custkey") % 10).alias("stop"),
        (F.col("o_orderkey") % 4).alias("service_id"),
        ((F.col("o_orderkey") * 37) % 86400).cast("int").alias("arrival_s"),
    )


# Routes of visits as the numbers the timetable uses.
ROUTE_NUMBERS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
SQL_ROUTE_NUMBER = "CASE route " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ROUTE_NUMBERS.items()) + " END"


def route_number(col: str = "route"):
    pairs = [F.lit(v) for item in ROUTE_NUMBERS.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), F.col(col))


# --- features and predictions ------------------------------------------------------------------

ROW_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d')"
FEATURE_COLS = ["quantity", "price", "discount", "tax"]

FEATURES = f"""features AS (
  SELECT {ROW_KEY} AS row_id, l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag = 'R' AS label, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS weekday,
         l_returnflag AS rflag, l_linestatus AS lstatus, l_shipdate AS ts
  FROM lineitem)"""


def features(t: Tables) -> DataFrame:
    row_id = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
    )
    return t.lineitem.select(
        row_id.alias("row_id"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").alias("label"),
        F.weekday("l_shipdate").alias("weekday"),
        F.col("l_returnflag").alias("rflag"),
        F.col("l_linestatus").alias("lstatus"),
        F.col("l_shipdate").alias("ts"),
    )


PREDICTIONS = f"""predictions AS (
  SELECT {ROW_KEY} AS row_id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
         CAST(l_partkey % 2 AS INTEGER) AS rf, CAST(l_suppkey % 3 = 0 AS INTEGER) AS xgb,
         CAST(l_linenumber > 3 AS INTEGER) AS cat, l_quantity AS actual, l_extendedprice / 1500.0 AS predicted,
         l_linenumber AS horizon, l_suppkey AS bus, l_orderkey % 20 AS route
  FROM lineitem)"""


def predictions(t: Tables) -> DataFrame:
    row_id = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
    )
    return t.lineitem.select(
        row_id.alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_partkey") % 2).cast("int").alias("rf"),
        (F.col("l_suppkey") % 3 == 0).cast("int").alias("xgb"),
        (F.col("l_linenumber") > 3).cast("int").alias("cat"),
        F.col("l_quantity").alias("actual"),
        (F.col("l_extendedprice") / 1500.0).alias("predicted"),
        F.col("l_linenumber").alias("horizon"),
        F.col("l_suppkey").alias("bus"),
        (F.col("l_orderkey") % 20).alias("route"),
    )


def metres_per_degree() -> float:
    return 6371000.0 * math.pi / 180
