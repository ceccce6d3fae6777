"""Queries: one per scalar function."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.functions import geo, text, times
from busweave.plans import bindings as B
from busweave.plans.registry import query

_HAV = B.sql_haversine("-25.25::DOUBLE", "-49.25::DOUBLE", "lat", "lon")

def _ref():
    return F.lit(-25.25), F.lit(-49.25)



@query("f01_haversine_m", B.sql(B.PINGS, body=f"SELECT event_id, round({_HAV}, 3) AS metres FROM pings"))
def _(t):
    return B.pings(t).select("event_id", F.round(geo.haversine_m(*_ref(), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query(
    "f01_haversine_single",
    B.sql(B.PINGS, body=f"SELECT event_id, CAST(round(CAST({_HAV} AS FLOAT)::DOUBLE, 1) AS DOUBLE) AS metres FROM pings"),
)
def _(t):
    single = geo.haversine_m(*_ref(), F.col("lat"), F.col("lon"), single=True)
    return B.pings(t).select("event_id", F.round(single.cast("double"), 1).alias("metres"))


@query("f02_haversine_km", B.sql(B.PINGS, body=f"SELECT event_id, round({_HAV}, 3) AS metres FROM pings"))
def _(t):
    return B.pings(t).select(
        "event_id", F.round(geo.haversine_km_m(*_ref(), F.col("lat"), F.col("lon")), 3).alias("metres")
    )


def _vincenty_sql() -> str:
    """Fixed rounds of the inverse formula, one view per round."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    parts = [
        B.PINGS,
        f"""v0 AS (SELECT event_id, atan({1 - f!r}::DOUBLE * tan(radians(-25.25::DOUBLE))) AS u1,
            atan({1 - f!r}::DOUBLE * tan(radians(lat))) AS u2, radians(lon + 49.25) AS span, radians(lon + 49.25) AS lam FROM pings)""",
    ]
    for i in range(12):
        parts.append(
            f"""s{i} AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{i})"""
        )
        parts.append(
            f"""a{i} AS (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM s{i})"""
        )
        parts.append(
            f"""m{i} AS (SELECT *, 1 - sa * sa AS c2a, CASE WHEN 1 - sa * sa = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS md FROM a{i})"""
        )
        parts.append(f"c{i} AS (SELECT *, {f!r}::DOUBLE / 16 * c2a * (4 + {f!r}::DOUBLE * (4 - 3 * c2a)) AS cc FROM m{i})")
        parts.append(
            f"""v{i + 1} AS (SELECT event_id, u1, u2, span, span + (1 - cc) * {f!r}::DOUBLE * sa * (sg + cc * ss * (md + cc * cs * (2 * md * md - 1))) AS lam,
            ss, cs, sg, c2a, md FROM c{i})"""
        )
        if i < 11:
            parts[-1] = parts[-1].replace(",\n            ss, cs, sg, c2a, md FROM", " FROM")
    parts.append(f"u AS (SELECT *, c2a * {(a * a - b * b) / (b * b)!r}::DOUBLE AS usq FROM v12)")
    parts.append(
        """ab AS (SELECT *, 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq))) AS ba,
        usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq))) AS bb FROM u)"""
    )
    return B.sql(
        *parts,
        body=f"""SELECT event_id, round(CASE WHEN ss = 0 THEN 0 ELSE {b!r}::DOUBLE * ba * (sg - bb * ss * (md + bb / 4 * (cs * (2 * md * md - 1)
        - bb / 6 * md * (4 * ss * ss - 3) * (4 * md * md - 3)))) END, 3) AS metres FROM ab""",
    )


@query("f03_geodesic_m", _vincenty_sql())
def _(t):
    return B.pings(t).select("event_id", F.round(geo.geodesic_m(*_ref(), F.col("lat"), F.col("lon")), 3).alias("metres"))


@query(
    "f04_bearing",
    B.sql(
        B.PINGS,
        body="""SELECT event_id, round((degrees(atan2(sin(radians(lon + 49.25)) * cos(radians(lat)),
        cos(radians(-25.25::DOUBLE)) * sin(radians(lat)) - sin(radians(-25.25::DOUBLE)) * cos(radians(lat)) * cos(radians(lon + 49.25)))) + 360.0) % 360.0, 6) AS bearing
        FROM pings""",
    ),
)
def _(t):
    return B.pings(t).select("event_id", F.round(geo.bearing_deg(*_ref(), F.col("lat"), F.col("lon")), 6).alias("bearing"))


def _utm_sql() -> str:
    a, f, k0 = geo.WGS84_A, geo.WGS84_F, geo.UTM_K0
    n = f / (2 - f)
    rect = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b1, b2, b3 = n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480
    d1, d2, d3 = 2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15
    dbl = lambda v: f"({v!r}::DOUBLE)"
    sh = lambda x: f"((exp({x}) - exp(-({x}))) / 2)"
    ch = lambda x: f"((exp({x}) + exp(-({x}))) / 2)"
    xip = "xi" + "".join(f" - {dbl(b)} * sin({2 * j} * xi) * {ch(f'{2 * j} * eta')}" for j, b in enumerate((b1, b2, b3), 1))
    etap = "eta" + "".join(f" - {dbl(b)} * cos({2 * j} * xi) * {sh(f'{2 * j} * eta')}" for j, b in enumerate((b1, b2, b3), 1))
    lat = "chi" + "".join(f" + {dbl(d)} * sin({2 * j} * chi)" for j, d in enumerate((d1, d2, d3), 1))
    return B.sql(
        f"""raw AS (SELECT o_orderkey, 200000 + o_totalprice AS x, 9000000 + o_custkey * 10.0 AS y FROM orders)""",
        f"s1 AS (SELECT *, (y - 10000000.0) / {dbl(rect)} AS xi, (x - 500000.0) / {dbl(rect)} AS eta FROM raw)",
        f"s2 AS (SELECT *, {xip} AS xip, {etap} AS etap FROM s1)",
        f"s3 AS (SELECT *, asin(sin(xip) / {ch('etap')}) AS chi FROM s2)",
        body=f"""SELECT o_orderkey, round(degrees({lat}), 7) AS lat, round(-33.0 + degrees(atan2({sh('etap')}, cos(xip))), 7) AS lon FROM s3""",
    )


@query("f05_utm_to_latlon", _utm_sql())
def _(t):
    lat, lon = geo.utm_to_latlon(200000 + F.col("o_totalprice"), 9000000 + F.col("o_custkey") * 10.0)
    return t.orders.select("o_orderkey", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(
    "f06_cell_key",
    B.sql(
        B.PINGS,
        body="""SELECT event_id, substr(CAST(lat AS VARCHAR), 1, 4) || ':' || substr(CAST(lon AS VARCHAR), 1, 5) AS cell,
        CAST(floor(lat / 0.1) AS BIGINT) AS ci, CAST(floor(lon / 0.1) AS BIGINT) AS cj FROM pings""",
    ),
)
def _(t):
    lat, lon = F.col("lat"), F.col("lon")
    return B.pings(t).select(
        "event_id",
        geo.cell_key(lat, lon).alias("cell"),
        geo.cell_index(lat, 0.1).alias("ci"),
        geo.cell_index(lon, 0.1).alias("cj"),
    )


@query(
    "f07_minutes_between",
    f"SELECT o_orderkey, {B.sql_minutes('o_orderkey * 97 % 86400', 'o_custkey * 89 % 86400')} AS minutes FROM orders",
)
def _(t):
    moment = lambda k, m: F.timestamp_seconds(F.col(k) * m % 86400)
    return t.orders.select(
        "o_orderkey", times.minutes_between(moment("o_orderkey", 97), moment("o_custkey", 89)).alias("minutes")
    )


@query(
    "f08_seconds_mod_day",
    """SELECT o_orderkey, ((o_custkey * 89 % 86400 - o_orderkey * 97 % 86400) % 86400 + 86400) % 86400 AS gap FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        times.seconds_mod_day(F.col("o_orderkey") * 97 % 86400, F.col("o_custkey") * 89 % 86400).alias("gap"),
    )


@query(
    "f09_ten_minute_tag",
    """SELECT event_id, substr(strftime(ts, '%H%M'), 1, 3) AS tag, substr(strftime(ts, '%H:%M'), 1, 4) AS tag_colon FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        times.hhm_bucket(F.col("ts")).alias("tag"),
        times.hhm_bucket(F.col("ts"), colon=True).alias("tag_colon"),
    )


@query(
    "f10_f11_hour_keys",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, strftime(ts, '%H:%Y-%m-%d') AS hour_date FROM events""",
)
def _(t):
    return t.events.select(
        "event_id", times.hour_of(F.col("ts")).alias("hour"), times.hour_date_key(F.col("ts")).alias("hour_date")
    )


@query(
    "f12_previous_day",
    """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 1, '%Y_%m_%d') AS day FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey", times.previous_day(F.date_format("o_orderdate", "yyyy_MM_dd")).alias("day")
    )


@query("f13_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", times.day_first(F.date_format("o_orderdate", "dd-MM-yyyy")).alias("day"))


@query(
    "f14_from_millis",
    """SELECT o_orderkey, strftime(make_timestamp((o_orderkey * 86400123 + 1483228800000) * 1000), '%Y-%m-%d %H:%M:%S') AS moment FROM orders""",
)
def _(t):
    moment = times.from_millis(F.col("o_orderkey") * 86400123 + 1483228800000)
    return t.orders.select("o_orderkey", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query(
    "f15_day_number",
    "SELECT event_id, round((floor(epoch(ts)) + 2209161600) / 86400.0, 6) AS day_number FROM events",
)
def _(t):
    return t.events.select("event_id", F.round(times.day_number(F.col("ts")), 6).alias("day_number"))


@query(
    "f16_date_parts",
    """SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
    CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday FROM orders""",
)
def _(t):
    return times.date_parts(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@query(
    "f17_f18_weekdays",
    "SELECT o_orderkey, dayname(o_orderdate) AS weekday, CAST(isodow(o_orderdate) AS INTEGER) AS day_index FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        times.weekday_name(F.col("o_orderdate")).alias("weekday"),
        times.calendar_day_index(F.col("o_orderdate")).alias("day_index"),
    )


@query(
    "f19_parse_points",
    """SELECT s_suppkey, s_acctbal AS x, s_suppkey * 1.5::DOUBLE AS y, CAST(2 AS INTEGER) AS n, s_acctbal + 1 AS x2 FROM supplier""",
)
def _(t):
    point = F.format_string('{"x": %s, "y": %s}', F.col("s_acctbal"), F.col("s_suppkey") * 1.5)
    line = F.format_string('[{"x": 0, "y": 0}, {"x": %s, "y": 1}]', F.col("s_acctbal") + 1)
    parsed = t.supplier.select("s_suppkey", text.parse_point(point).alias("p"), text.parse_line(line).alias("l"))
    return parsed.select("s_suppkey", "p.x", "p.y", F.size("l").alias("n"), F.col("l")[1]["x"].alias("x2"))


@query(
    "f20_abbreviate_street",
    """SELECT s_suppkey, replace(replace(CASE WHEN s_suppkey % 2 = 0 THEN 'Avenida ' ELSE 'Rua ' END || s_name, 'Avenida', 'Av.'), 'Rua', 'R.') AS street FROM supplier""",
)
def _(t):
    street = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Avenida ").otherwise("Rua "), "s_name")
    return t.supplier.select("s_suppkey", text.abbreviate_street(street).alias("street"))


@query(
    "f21_text_to_number",
    "SELECT s_suppkey, s_acctbal AS number, CAST(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS INTEGER) AS whole, s_acctbal AS comma FROM supplier",
)
def _(t):
    quoted = F.concat(F.lit(' "'), F.col("s_acctbal").cast("string"), F.lit('" '))
    dirty = F.when(F.col("s_suppkey") % 3 == 0, "-").otherwise(F.col("s_suppkey").cast("string"))
    comma = F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(","))
    return t.supplier.select(
        "s_suppkey",
        text.to_number(quoted).alias("number"),
        text.to_number(dirty, "int").alias("whole"),
        text.decimal_comma(comma).alias("comma"),
    )


@query(
    "f22_f23_fill_and_cast",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_tax, 0), l_discount) AS filled,
    coalesce(nullif(l_quantity, 1), 0) AS zeroed, CAST(l_returnflag = 'R' AS INTEGER) AS flag FROM lineitem""",
)
def _(t):
    from busweave.operators.features import fill_missing

    holes = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_discount",
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("filled"),
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("zeroed"),
        (F.col("l_returnflag") == "R").cast("int").alias("flag"),
    )
    return fill_missing(holes, {"filled": "l_discount", "zeroed": 0.0}).drop("l_discount")


@query(
    "f24_residual_of_totals",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    round(l_extendedprice * 1000 / 60 - (l_quantity + l_discount + l_tax), 4) AS rest FROM lineitem""",
)
def _(t):
    from busweave.operators.features import residual_of_totals

    rest = residual_of_totals("l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(rest, 4).alias("rest"))


@query(
    "f25_mode_index",
    """SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS INTEGER) AS mode FROM events""",
)
def _(t):
    name = F.try_element_at(
        F.create_map(*[F.lit(v) for v in ("view", "walk", "click", "bike", "signup", "bus", "purchase", "taxi", "error", "boat")]),
        F.col("event_type"),
    )
    return t.events.select("event_id", text.mode_index(name).alias("mode"))


@query(
    "f26_f29_shape_measures",
    B.sql(
        B.SHAPES,
        """lines AS (SELECT shape, max(dist) AS total, count(*) AS n, arg_min(lat, seq) AS lat1, arg_min(lon, seq) AS lon1,
           arg_max(lat, seq) AS lat2, arg_max(lon, seq) AS lon2 FROM shapes GROUP BY shape)""",
        body=f"""SELECT shape, CAST(floor(total / (n * 0.09::DOUBLE)) AS INTEGER) AS threshold_m,
        {B.sql_haversine('lat1', 'lon1', 'lat2', 'lon2')} <= 20000 AS round_trip,
        {B.sql_haversine('lat1', 'lon1', 'lat2', 'lon2')} > floor(total / (n * 0.09::DOUBLE)) AS off_shape,
        total * 3 AS coverage, total * 1000 AS metres FROM lines""",
    ),
)
def _(t):
    lines = (
        B.shapes(t)
        .groupBy("shape")
        .agg(
            F.max("dist").alias("total"),
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct("lat", "lon"), "seq").alias("a"),
            F.max_by(F.struct("lat", "lon"), "seq").alias("b"),
        )
    )
    apart = geo.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    threshold = geo.shape_threshold_m(F.col("total"), F.col("n"))
    return lines.select(
        "shape",
        threshold.alias("threshold_m"),
        geo.is_round_trip(apart, F.lit(20000)).alias("round_trip"),
        geo.off_shape(apart, threshold).alias("off_shape"),
        geo.length_coverage(F.col("total"), F.lit(3)).alias("coverage"),
        geo.shape_distance_m(F.col("total"), True).alias("metres"),
    )
