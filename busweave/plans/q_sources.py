"""Queries: files written from the tables and read back, and streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.plans import bindings as B
from busweave.plans.registry import query
from busweave.session import scratch_dir
from busweave.sources import readers as R
from busweave.sources import writers as W
from busweave.streaming import feeds as ST
from busweave.streaming.versions import read_by_day, upsert_by_day

_ORDER = "o_orderkey bigint, o_custkey bigint, o_orderpriority string"


@query("s01_k01_csv_scan", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(t):
    path = scratch_dir(t.spark, "csv")
    W.write_csv(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    return R.read_csv(t.spark, path, _ORDER)


@query("s02_s03_k03_days", "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def _(t):
    path = scratch_dir(t.spark, "days")
    W.write_by_day(t.events.select("event_id", "user_id", "ts"), path, "ts")
    out = R.read_days(t.spark, f"{path}/day=*/part-*", "event_id bigint, user_id bigint, ts string")
    return out.select("event_id", "user_id", F.col("day").cast("string").alias("day"))


@query("s03_day_folders", "SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'")
def _(t):
    path = scratch_dir(t.spark, "day-folders")
    W.write_by_day(t.events.select("event_id", "user_id", "ts"), path, "ts")
    out = R.read_day_folders(t.spark, path, "event_id bigint, user_id bigint, ts string").where("day >= '2024-01-20'")
    return out.select("event_id", "user_id", F.col("day").cast("string").alias("day"))


@query("k02_by_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(t):
    path = scratch_dir(t.spark, "months")
    W.write_by_month(t.orders.select("o_orderkey", "o_orderdate"), path, "o_orderdate")
    out = t.spark.read.schema("o_orderkey bigint, o_orderdate string, month string").option("header", True).csv(path)
    return out.select("o_orderkey", "month")


@query(
    "k03_weather_by_day",
    B.sql(B.PINGS, body="SELECT event_id, k, strftime(ts, '%Y-%m-%d') AS day, value FROM pings"),
)
def _(t):
    path = scratch_dir(t.spark, "weather")
    rows = B.pings(t).select("event_id", F.col("value").alias("lat"), F.col("k").alias("lon"), "ts")
    W.write_weather_by_day(rows, path, "ts")
    out = t.spark.read.schema("event_id bigint, lat int, lon double, ts string, day string").option("header", True).csv(path)
    return out.select("event_id", F.col("lat").alias("k"), "day", F.col("lon").alias("value"))


@query("k04_by_shape", "SELECT CAST(p_size % 5 AS INTEGER) AS route_id, p_size AS shape_id, p_partkey FROM part")
def _(t):
    path = scratch_dir(t.spark, "shapes")
    rows = t.part.select((F.col("p_size") % 5).alias("route_id"), F.col("p_size").alias("shape_id"), "p_partkey")
    W.write_by_shape(rows, path)
    return t.spark.read.schema("p_partkey bigint, route_id int, shape_id int").option("header", True).csv(path)


@query("k05_merge_parts", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(t):
    parts, merged = scratch_dir(t.spark, "parts"), scratch_dir(t.spark, "merged")
    W.write_csv(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").repartition(4, "o_orderkey"), parts)
    W.merge_parts(t.spark, parts, merged, schema=_ORDER)
    return R.read_csv(t.spark, merged, _ORDER)


@query(
    "s04_vehicle_json",
    B.sql(
        B.PINGS,
        body="""SELECT CAST(bus AS VARCHAR) AS bus_code, lat AS latitude, lon AS longitude, s, strftime(ts, '%H:%M:%S') AS time_of_day, route AS line_code FROM pings""",
    ),
)
def _(t):
    path = scratch_dir(t.spark, "vehicles")
    B.pings(t).select(
        F.col("bus").cast("string").alias("VEIC"),
        F.replace(F.col("lat").cast("string"), F.lit("."), F.lit(",")).alias("LAT"),
        F.col("lon").cast("string").alias("LON"),
        F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("DTHR"),
        F.col("route").alias("COD_LINHA"),
    ).write.json(path)
    out = R.read_vehicle_json(t.spark, path)
    return out.withColumn("s", F.col("timestamp").cast("long")).drop("timestamp")


@query(
    "s05_weather",
    B.sql(B.STATIONS, body="SELECT CAST(station AS VARCHAR) AS station, lat, lon, 1704067200 + station * 60 AS s, station / 10.0::DOUBLE AS precipitation FROM stations"),
)
def _(t):
    path = scratch_dir(t.spark, "rain")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    rows = B.stations(t).select(
        F.lit("CG").alias("municipio"),
        F.col("station").cast("string").alias("codEstacao"),
        F.lit("PB").alias("uf"),
        F.lit("name").alias("nomeEstacao"),
        comma(F.col("lat")).alias("latitude"),
        comma(F.col("lon")).alias("longitude"),
        F.concat(F.date_format(F.timestamp_seconds(1704067200 + F.col("station") * 60), "yyyy-MM-dd HH:mm:ss"), F.lit(".0")).alias("datahora"),
        comma(F.col("station") / 10.0).alias("valorMedida"),
    )
    W.write_csv(rows, path, sep=";")
    return R.read_weather(t.spark, path).withColumn("s", F.col("ts").cast("long")).drop("ts")


_REPORT = "s_suppkey AS id, s_acctbal AS x, s_suppkey * 1.5::DOUBLE AS y, 1483228800 + s_suppkey * 86400 AS s"


@query("s06_alerts", f"SELECT {_REPORT}, s_name || ', \"old\" road' AS street, CAST(s_suppkey % 11 AS INTEGER) AS confidence FROM supplier")
def _(t):
    path = scratch_dir(t.spark, "alerts")
    k = F.col("s_suppkey")
    wanted = [c.strip().split(" ")[0] for c in R.schemas.ALERTS.split(", ")]
    have = {
        "location": F.format_string('{"x": %s, "y": %s}', F.col("s_acctbal"), k * 1.5),
        "pubMillis": (1483228800 + k * 86400) * 1000,
        "street": F.concat("s_name", F.lit(', "old" road')),
        "confidence": (k % 11).cast("int"),
        "uuid": k.cast("string"),
    }
    W.write_csv(t.supplier.select(F.lit("x").alias("extra"), *[have.get(c, F.lit(None).cast("string")).alias(c) for c in reversed(wanted)]), path)
    out = R.read_alerts(t.spark, path)
    return out.select(F.col("alert_id").cast("long").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("ts").cast("long").alias("s"), "street", "confidence")


@query("s06_jams", f"SELECT {_REPORT}, CASE WHEN s_suppkey % 2 = 0 THEN 'ROAD' END AS block, CAST(2 AS INTEGER) AS n FROM supplier")
def _(t):
    path = scratch_dir(t.spark, "jams")
    k = F.col("s_suppkey")
    wanted = [c.strip().split(" ")[0] for c in R.schemas.JAMS.split(", ")]
    have = {
        "line": F.format_string('[{"x": %s, "y": %s}, {"x": 1, "y": 2}]', F.col("s_acctbal"), k * 1.5),
        "updateMillis": (1483228800 + k * 86400) * 1000,
        "blockType": F.when(k % 2 == 0, "ROAD").otherwise("NONE"),
        "uuid": k.cast("string"),
    }
    W.write_csv(t.supplier.select(F.lit("x").alias("extra"), *[have.get(c, F.lit(None).cast("string")).alias(c) for c in reversed(wanted)]), path)
    out = R.read_jams(t.spark, path)
    first = F.col("line")[0]
    return out.select(
        F.col("jam_id").cast("long").alias("id"), first["x"].alias("x"), first["y"].alias("y"), F.col("ts").cast("long").alias("s"),
        F.col("blockType").alias("block"), F.size("line").alias("n"),
    )


@query(
    "s07_gtfs",
    """SELECT 'routes' AS file, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS key_sum FROM part UNION ALL
    SELECT 'trips', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders UNION ALL
    SELECT 'stops', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer UNION ALL
    SELECT 'stop_times', count(*), CAST(sum(l_linenumber) AS BIGINT) FROM lineitem UNION ALL
    SELECT 'shapes', count(*), CAST(sum(l_partkey) AS BIGINT) FROM lineitem UNION ALL
    SELECT 'calendar', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation""",
)
def _(t):
    folder = scratch_dir(t.spark, "gtfs")
    sources = {
        "routes": (t.part, {"route_id": "p_partkey", "route_long_name": "p_name"}, "route_id"),
        "trips": (t.orders, {"trip_id": "o_orderkey", "route_id": "o_custkey"}, "trip_id"),
        "stops": (t.customer, {"stop_id": "c_custkey", "stop_name": "c_name", "stop_lat": "c_acctbal"}, "stop_id"),
        "stop_times": (t.lineitem, {"trip_id": "l_orderkey", "stop_sequence": "l_linenumber"}, "stop_sequence"),
        "shapes": (t.lineitem, {"shape_id": "l_orderkey", "shape_pt_sequence": "l_partkey", "shape_dist_traveled": "l_quantity"}, "shape_pt_sequence"),
        "calendar": (t.nation, {"service_id": "n_nationkey", "monday": "n_regionkey"}, "service_id"),
    }
    for name, (table, have, _key) in sources.items():
        cols = [c.strip().split(" ")[0] for c in R.schemas.GTFS[name].split(", ")]
        rows = table.select(*[(F.col(have[c]).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in cols])
        W.write_csv(rows, f"{folder}/{name}.txt")
    feed = R.read_gtfs(t.spark, folder)
    out = None
    for name, (_table, _have, key) in sources.items():
        one = feed[name].agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("n"), F.sum(F.col(key).cast("long")).alias("key_sum"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s08_trajectory", B.sql(B.PINGS, body="SELECT CAST(7 AS INTEGER) AS user, lat, lon, s / 86400.0 AS day_number FROM pings WHERE event_id % 4 <> 0"))
def _(t):
    path = f"{scratch_dir(t.spark, 'track')}/combined7.plt"
    number = F.col("s") / 86400.0
    line = F.concat_ws(",", *[c.cast("string") for c in (F.col("lat"), F.col("lon"), F.lit(0), F.lit(492), number)], F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    short = F.when(F.col("event_id") % 4 == 0, F.concat_ws(",", F.col("lat").cast("string"), F.lit("header"))).otherwise(line)
    B.pings(t).select(short.alias("value")).write.text(path)
    return R.read_trajectory(t.spark, path, r"combined(\d+)\.plt")


@query("s09_mode_labels", "SELECT CAST(7 AS INTEGER) AS user, o_orderkey + 1000000000 AS start_s, o_orderkey + 1000003600 AS end_s, o_orderstatus AS mode FROM orders WHERE o_custkey % 5 <> 0")
def _(t):
    path = f"{scratch_dir(t.spark, 'labels')}/labels7.txt"
    moment = lambda by: F.date_format(F.timestamp_seconds(F.col("o_orderkey") + by), "yyyy/MM/dd HH:mm:ss")
    full = F.concat_ws("\t", moment(1000000000), moment(1000003600), "o_orderstatus")
    t.orders.select(F.when(F.col("o_custkey") % 5 == 0, "Start Time\tEnd Time").otherwise(full).alias("value")).write.text(path)
    out = R.read_mode_labels(t.spark, path)
    return out.select("user", F.col("start").cast("long").alias("start_s"), F.col("end").cast("long").alias("end_s"), "mode")


@query("s10_documents", "SELECT conv_id, turn, role, length(text) AS place_n FROM conversations")
def _(t):
    path = scratch_dir(t.spark, "docs")
    talk = t.read("conversations")
    talk.select("conv_id", "turn", "role", "text", F.struct(F.length("text").alias("n")).alias("place")).write.json(path)
    return R.read_documents(t.spark, path, {"conv_id": "bigint", "turn": "bigint", "role": "string", "place.n": "bigint"})


@query(
    "s11_vehicle_feed",
    B.sql(
        B.PINGS,
        body="""SELECT CAST(shape AS VARCHAR) AS shape, CAST(event_id AS VARCHAR) AS id, lat, lon, route AS line FROM pings
        UNION ALL SELECT CAST(shape AS VARCHAR), 'x' || event_id, lat, lon, 'REC' FROM pings""",
    ),
)
def _(t):
    one = lambda vid, line: F.struct(vid.alias("id"), F.col("lat"), F.col("lon"), line.alias("line"))
    feed = F.to_json(
        F.create_map(
            F.col("shape").cast("string"),
            F.array(one(F.col("event_id").cast("string"), F.col("route")), one(F.concat(F.lit("x"), F.col("event_id").cast("string")), F.lit("REC"))),
        )
    )
    return R.explode_vehicle_feed(B.pings(t).select(feed.alias("feed")), "feed").drop("time")


# --- streams -----------------------------------------------------------------------------------


def _feed(t):
    raw = t.spark.read.parquet(t.path("events"))
    # A pattern works for a single file as well as for a folder of files.
    return ST.read_feed(t.spark, t.path("events") + "*", raw.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("t02_upsert_stream", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def _(t):
    target, mark = scratch_dir(t.spark, "upsert"), scratch_dir(t.spark, "upsert-mark")
    ST.upsert_stream(_feed(t), "user_id", "ts", target, mark, tie="event_id").awaitTermination()
    return ST.read_upserted(t.spark, "user_id", "ts", target, tie="event_id").select("user_id", "event_id", "event_type")


@query(
    "t02_upsert_by_day",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
    FROM events GROUP BY 1, 2""",
)
def _(t):
    target, mark = scratch_dir(t.spark, "by-day"), scratch_dir(t.spark, "by-day-mark")
    upsert_by_day(_feed(t), "user_id", "ts", target, mark, tie="event_id").awaitTermination()
    out = read_by_day(t.spark, target).withColumn("day", F.col("day").cast("string"))
    return out.select("user_id", "day", "event_id", "event_type")


@query("t02_distinct_stream", "SELECT event_id, user_id FROM events")
def _(t):
    target, mark = scratch_dir(t.spark, "distinct"), scratch_dir(t.spark, "distinct-mark")
    feed = _feed(t)
    ST.distinct_stream(feed.unionByName(feed), "event_id", "ts", "1 hour", target, mark).awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "user_id")


@query("t03_append_by_day", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(t):
    target, mark = scratch_dir(t.spark, "append"), scratch_dir(t.spark, "append-mark")
    ST.append_by_day(_feed(t), "ts", target, mark).awaitTermination()
    out = t.spark.read.schema("event_id bigint, user_id bigint, day string").parquet(target)
    return out.select("event_id", "user_id", "day")
