"""Queries: projections, filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.functions.text import dash_to_null, null_to_dash
from busweave.operators import shaping as S
from busweave.operators.ordered import blocks_of, hours
from busweave.plans import bindings as B
from busweave.plans import q_scalars  # noqa: F401  (its SQL of planar coordinates)
from busweave.plans.registry import SQL, query

# Raw pings: text columns with dashes and blanks where data is missing, some vehicles out of service.
_RAW = """raw AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS "VEIC",
         CASE WHEN user_id % 11 = 0 THEN '-' WHEN user_id % 13 = 0 THEN '' ELSE CAST(user_id % 200 AS VARCHAR) END AS "LAT",
         CASE WHEN event_id % 17 = 0 THEN '-' ELSE CAST(event_id AS VARCHAR) END AS "LON",
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "DTHR",
         CASE event_type WHEN 'error' THEN 'REC' WHEN 'view' THEN '-' ELSE event_type END AS "COD_LINHA"
  FROM events)"""


def _raw(t):
    i, u = F.col("event_id"), F.col("user_id")
    return t.events.select(
        "event_id",
        u.cast("string").alias("VEIC"),
        F.when(u % 11 == 0, "-").when(u % 13 == 0, "").otherwise((u % 200).cast("string")).alias("LAT"),
        F.when(i % 17 == 0, "-").otherwise(i.cast("string")).alias("LON"),
        F.when(i % 19 == 0, None).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("DTHR"),
        F.when(F.col("event_type") == "error", "REC").when(F.col("event_type") == "view", "-").otherwise(F.col("event_type")).alias("COD_LINHA"),
    )


def _gps(t):
    return S.standardise_gps(_raw(t), S.GPS_MAPPINGS["curitiba"], "event_id")


_GPS = """gps AS (SELECT "VEIC" AS bus_code, "LAT" AS latitude, "LON" AS longitude, "DTHR" AS "timestamp",
  "COD_LINHA" AS line_code, event_id AS gps_id FROM raw)"""


@query("p01_standardise_gps", B.sql(_RAW, _GPS, body="SELECT * FROM gps"))
def _(t):
    return _gps(t)


@query(
    "p01_standardise_planar",
    f"""SELECT o_orderkey AS gps_id, o_orderkey % 5 AS bus_code, CASE WHEN o_orderkey % 7 > 1 THEN lat END AS latitude, CASE WHEN o_orderkey % 7 > 1 THEN lon END AS longitude
    FROM ({SQL["f05_utm_to_latlon"]})""",
)
def _(t):
    key = F.col("o_orderkey")
    gone = lambda c: F.when(key % 7 == 0, "-").when(key % 7 == 1, "0").otherwise(c.cast("string"))
    raw = t.orders.select(
        key,
        (key % 5).alias("Unidad"),
        gone(200000 + F.col("o_totalprice")).alias("CoordX"),
        gone(9000000 + F.col("o_custkey") * 10.0).alias("CoordY"),
    )
    columns = {c: v for c, v in S.GPS_MAPPINGS["recife"].items() if v in raw.columns}
    out = S.standardise_gps(raw, columns, "o_orderkey", utm_zone=25)
    return out.withColumns({c: F.round(c, 7) for c in ("latitude", "longitude")})


@query(
    "p02_reorder",
    "SELECT c_mktsegment, c_name, CAST(NULL AS VARCHAR) AS street, c_custkey FROM customer",
)
def _(t):
    return S.reorder(t.customer, ["c_mktsegment", "c_name", "street", "c_custkey"])


@query("p03_in_city", "SELECT n_nationkey, n_name FROM nation WHERE contains(n_name, '1')")
def _(t):
    return S.in_city(t.nation, "1", "n_name").select("n_nationkey", "n_name")


@query(
    "p04_drop_unlocated",
    B.sql(_RAW, _GPS, body="SELECT gps_id, line_code FROM gps WHERE line_code <> '-' AND latitude NOT IN ('', '-') AND longitude <> '-'"),
)
def _(t):
    return S.drop_unlocated(_gps(t)).select("gps_id", "line_code")


@query("p05_has_time", B.sql(_RAW, _GPS, body="SELECT gps_id, \"timestamp\" FROM gps WHERE \"timestamp\" IS NOT NULL"))
def _(t):
    return S.has_time(_gps(t)).select("gps_id", "timestamp")


@query(
    "p06_usable_for_bunching",
    """SELECT event_id, nullif(user_id % 7, 0) AS gps_lat FROM events
    WHERE user_id % 7 <> 0 AND event_id % 5 <> 0""",
)
def _(t):
    rows = t.events.select(
        "event_id",
        F.nullif(F.col("user_id") % 7, F.lit(0)).alias("gps_lat"),
        F.when(F.col("event_id") % 5 == 0, "TRIP_PROBLEM").when(F.col("event_id") % 5 == 1, "NO_PROBLEM").alias("problem"),
    )
    return S.usable_for_bunching(rows).drop("problem")


@query(
    "p07_row_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS ids FROM orders",
)
def _(t):
    rows = S.drop_features(t.orders, ["o_orderdate"]).select("o_orderkey")
    return S.with_row_id(rows, ["o_orderkey"], blocks_of("o_orderkey", 4096)).withColumn("ids", F.col("row_id"))


@query("p08_in_service", B.sql(_RAW, _GPS, body="SELECT gps_id, line_code FROM gps WHERE line_code <> 'REC'"))
def _(t):
    return S.in_service(_gps(t)).select("gps_id", "line_code")


@query(
    "p09_headway_over",
    B.sql(B.VISITS, B.LABELLED, body="""SELECT event_id, headway_min, CASE WHEN headway_min > 600 THEN 600 WHEN headway_min > 360 THEN 360
    WHEN headway_min > 240 THEN 240 ELSE 120 END AS over FROM labelled WHERE headway_min > 120"""),
)
def _(t):
    band = F.lit(120)
    for m in (240, 360, 600):
        band = F.when(F.col("headway_min") > m, m).otherwise(band)
    return S.headway_over(B.labelled(t), 120).select("event_id", "headway_min", band.alias("over"))


@query(
    "p10_text_and_equality",
    """SELECT event_id, user_id FROM events WHERE contains(strftime(ts, '%Y-%m-%d %H:%M:%S'), '-15 ') AND event_type = 'view'""",
)
def _(t):
    rows = t.events.withColumn("moment", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return S.where_equal(S.where_contains(rows, "moment", "-15 "), event_type="view").select("event_id", "user_id")


@query(
    "p11_feature_group",
    """SELECT l_orderkey AS route, l_partkey AS "shapeId", l_quantity AS "shapeSequence", l_tax AS precipitation, l_partkey + 1 AS "shapeIdSB" FROM lineitem""",
)
def _(t):
    wide = t.lineitem.select(
        F.col("l_orderkey").alias("route"),
        F.col("l_partkey").alias("shapeId"),
        F.col("l_quantity").alias("shapeSequence"),
        F.col("l_tax").alias("precipitation"),
        F.col("l_discount").alias("jamDelay"),
        (F.col("l_partkey") + 1).alias("shapeIdSB"),
    )
    return S.feature_group(wide, "gps", "gtfs", "weather")


@query("p12_p13_drop_and_position", "SELECT o_custkey, o_totalprice FROM orders")
def _(t):
    return S.by_position(S.drop_features(t.orders, ["o_orderkey", "o_orderdate"]), [0, 2])


@query(
    "p14_dash_and_null",
    B.sql(_RAW, _GPS, body="""SELECT gps_id, nullif(latitude, '-') AS latitude, nullif(line_code, '-') AS line_code,
    coalesce(nullif(longitude, '-'), '-') AS longitude, coalesce("timestamp", '-') AS "timestamp" FROM gps"""),
)
def _(t):
    nulls = dash_to_null(_gps(t).drop("bus_code"), ["latitude", "longitude", "line_code"])
    return null_to_dash(nulls, ["longitude", "timestamp"])


@query("p15_one_class", B.sql(B.FEATURES, body="SELECT row_id, quantity FROM features WHERE NOT label"))
def _(t):
    return S.one_class(B.features(t), "label").select("row_id", "quantity")


@query("o01_sort_as_text", "SELECT o_orderkey, o_custkey FROM orders ORDER BY CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)")
def _(t):
    return S.sort_by(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])


@query("o02_sort_stable", "SELECT event_id, user_id FROM events ORDER BY ts, event_id")
def _(t):
    return S.sort_stable(t.events, "ts", "event_id").select("event_id", "user_id")


@query("o03_sort_vehicle", "SELECT event_id, user_id AS bus FROM events ORDER BY user_id, ts")
def _(t):
    rows = t.events.select("event_id", F.col("user_id").alias("bus"), "ts")
    return S.sort_vehicle(rows).select("event_id", "bus")


@query("o04_sort_pair", B.sql(B.VISITS, B.LABELLED, body="SELECT event_id, bus, bus2 FROM labelled ORDER BY bus, bus2, ts"))
def _(t):
    return S.sort_pair(B.labelled(t)).select("event_id", "bus", "bus2")


@query("o05_first_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1001")
def _(t):
    return S.first_n(t.orders, 1001, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query(
    "o06_top_values",
    """SELECT l_suppkey, max(v) FILTER (rn = 1) AS top1, max(v) FILTER (rn = 2) AS top2, max(v) FILTER (rn = 3) AS top3
    FROM (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem)
    WHERE rn <= 3 GROUP BY l_suppkey""",
)
def _(t):
    top = S.top_values(t.lineitem, ["l_suppkey"], "l_extendedprice", 3)
    return top.select("l_suppkey", *[F.get("top", F.lit(i)).alias(f"top{i + 1}") for i in range(3)])


@query("o08_lowest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def _(t):
    return S.lowest(t.orders, "o_totalprice", 20, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "o09_slice_rows",
    """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events)
    WHERE rn > 10 AND rn <= 30""",
)
def _(t):
    return S.slice_rows(t.events, "user_id", ["ts"], hours("ts", 86400), 10, 30).select("event_id", "user_id")


@query("o10_ordered_distinct", "SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders ORDER BY 1")
def _(t):
    return S.ordered_distinct(t.orders.select(F.to_date("o_orderdate").cast("string").alias("day")), "day")


@query(
    "u01_union_days",
    """SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return S.union_days([a, t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))])


@query("u03_distinct_times", "SELECT DISTINCT strftime(ts, '%H:%M') AS moment FROM events")
def _(t):
    return S.distinct_times(t.events.select(F.date_format("ts", "HH:mm").alias("moment")), "moment")


@query("u04_intersect_rows", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity >= 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity <= 26")
def _(t):
    part = t.lineitem.select(F.col("l_partkey").alias("k"), "l_quantity")
    return S.intersect_rows(part.where("l_quantity >= 25").select("k"), part.where("l_quantity <= 26").select("k"))


@query(
    "u05_first_per_key",
    "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return S.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("u06_other_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(t):
    return t.part.select(*S.other_columns(t.part, ["p_name", "p_brand", "p_type"]))


@query(
    "j15_rows_like",
    B.sql(B.FEATURES, body="SELECT row_id, quantity FROM features f WHERE EXISTS (SELECT 1 FROM features g WHERE g.row_id = f.row_id AND g.label)"),
)
def _(t):
    f = B.features(t)
    return S.rows_like(f, f.where("label")).select("row_id", "quantity")


@query(
    "j16_wrong_predictions_to_rows",
    B.sql(
        B.FEATURES,
        B.PREDICTIONS,
        body="SELECT row_id, price FROM features f WHERE EXISTS (SELECT 1 FROM predictions p WHERE p.row_id = f.row_id AND p.rf <> p.label)",
    ),
)
def _(t):
    return S.rows_like(B.features(t), B.predictions(t).where("rf <> label")).select("row_id", "price")


@query(
    "w06_ping_id",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS gps_id FROM events""",
)
def _(t):
    return S.with_ping_id(t.events, ["ts"], hours("ts", 86400), ["user_id"]).select("event_id", "gps_id")
