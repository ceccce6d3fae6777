"""Queries: feature preparation, correlations and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.operators import features as FE
from busweave.operators import stats as ST
from busweave.plans import bindings as B
from busweave.plans.registry import query

_HOLES = """holes AS (SELECT row_id, weekday, CASE WHEN pk % 7 = 0 THEN NULL ELSE price END AS price, CASE WHEN sk % 5 = 0 THEN NULL ELSE quantity END AS quantity FROM features)"""


def _holes(t):
    return B.features(t).select(
        "row_id",
        "weekday",
        F.when(F.col("pk") % 7 != 0, F.col("price")).alias("price"),
        F.when(F.col("sk") % 5 != 0, F.col("quantity")).alias("quantity"),
    )


@query(
    "m01_impute_group_median",
    B.sql(
        B.FEATURES,
        _HOLES,
        "med AS (SELECT weekday, quantile_cont(price, 0.5) AS p, quantile_cont(quantity, 0.5) AS q FROM holes GROUP BY 1)",
        body="SELECT row_id, round(coalesce(price, p), 4) AS price, coalesce(quantity, q) AS quantity FROM holes JOIN med USING (weekday)",
    ),
)
def _(t):
    out = FE.impute_group_median(_holes(t), ["price", "quantity"], ["weekday"])
    return out.select("row_id", F.round("price", 4).alias("price"), "quantity")


@query(
    "m02_one_hot",
    B.sql(
        B.FEATURES,
        body="SELECT row_id, "
        + ", ".join(f"CAST(rflag = '{v}' AS INTEGER) AS \"rflag_{v}\"" for v in "ANR")
        + ", "
        + ", ".join(f"CAST(lstatus = '{v}' AS INTEGER) AS \"lstatus_{v}\"" for v in "FO")
        + " FROM features",
    ),
)
def _(t):
    rows = B.features(t).select("row_id", "rflag", "lstatus")
    return FE.one_hot(rows, FE.known_values(rows, ["rflag", "lstatus"]))


@query(
    "m02_one_hot_vector",
    B.sql(
        B.FEATURES,
        """p AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS slot FROM (SELECT DISTINCT CAST(pk AS VARCHAR) AS value FROM features)),
        s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 + (SELECT count(*) FROM p) AS slot FROM (SELECT DISTINCT CAST(sk AS VARCHAR) AS value FROM features))""",
        body="SELECT row_id, p.slot AS part_slot, s.slot AS supplier_slot FROM features JOIN p ON p.value = CAST(pk AS VARCHAR) JOIN s ON s.value = CAST(sk AS VARCHAR)",
    ),
)
def _(t):
    rows = B.features(t).select("row_id", F.col("pk").cast("string").alias("part"), F.col("sk").cast("string").alias("supplier"))
    out, _ = FE.one_hot_vector(rows, ["part", "supplier"])
    hot = F.unwrap_udt("one_hot")["indices"]
    return out.select("row_id", hot[0].cast("long").alias("part_slot"), hot[1].cast("long").alias("supplier_slot"))


@query(
    "m03_label_codes",
    B.sql(
        B.FEATURES,
        body="SELECT row_id, dense_rank() OVER (ORDER BY rflag) - 1 AS rflag, dense_rank() OVER (ORDER BY quantity) - 1 AS quantity FROM features",
    ),
)
def _(t):
    return FE.label_codes(B.features(t).select("row_id", "rflag", "quantity"), ["rflag", "quantity"])


@query(
    "m04_min_max",
    B.sql(
        B.FEATURES,
        "b AS (SELECT min(price) AS lo, max(price) AS hi, min(tax) AS tlo, max(tax) AS thi FROM features)",
        body="SELECT row_id, round((price - lo) / (hi - lo), 9) AS price, round((tax - tlo) / (thi - tlo), 9) AS tax, CAST(0 AS DOUBLE) AS constant FROM features, b",
    ),
)
def _(t):
    rows = B.features(t).select("row_id", "price", "tax", F.lit(7.0).alias("constant"))
    out = FE.min_max(rows, ["price", "tax", "constant"])
    return out.withColumns({c: F.round(c, 9) for c in ("price", "tax")})


_SCALE = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(m, 4) AS centre, round(CASE WHEN s <= 2.3e-16 THEN 1.0 ELSE s END, 4) AS scale FROM
    (SELECT m, 2.0 * greatest(abs(l - m), abs(h - m)) AS s FROM (SELECT quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.0005) AS l, quantile_cont({c}, 0.0095) AS h FROM features))"""
    for c in B.FEATURE_COLS
)


@query("m06_robust_scale", B.sql(B.FEATURES, body=_SCALE))
def _(t):
    out = FE.robust_scale(B.features(t), B.FEATURE_COLS)
    return out.select("feature", F.round("centre", 4).alias("centre"), F.round("scale", 4).alias("scale"))


_HASH = "(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT)"


@query("m07_split", B.sql(B.FEATURES, body=f"SELECT row_id, {_HASH.format(k='row_id')} % 100 < 80 AS is_train FROM features"))
def _(t):
    return FE.split(B.features(t), "row_id", 0.8).select("row_id", "is_train")


@query(
    "m08_undersample",
    B.sql(
        "base AS (SELECT o_orderkey, o_totalprice > 400000 AS label FROM orders)",
        f"hashed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) AS rn FROM base)",
        "small AS (SELECT min(n) AS n FROM (SELECT label, count(*) AS n FROM base GROUP BY 1))",
        body="SELECT o_orderkey, label FROM hashed, small WHERE rn <= n",
    ),
)
def _(t):
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") > 400000).alias("label"))
    return FE.undersample(rows, "label", "o_orderkey")


_DAYS = ["2024-01-03", "2024-01-10", "2024-01-17", "2024-01-24"]


@query(
    "m09_day_subset",
    "SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) IN ("
    + ", ".join(f"DATE '{d}'" for d in _DAYS)
    + ")",
)
def _(t):
    return FE.day_subset(t.events, _DAYS).select("event_id", "user_id")


@query(
    "m09_day_shares",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1",
)
def _(t):
    out = FE.day_shares(t.events)
    return out.select(F.col("day").cast("string").alias("day"), "rows", F.round("share", 9).alias("share"))


# --- correlations ------------------------------------------------------------------------------


def _matrix_sql(expr: str, source: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {expr.format(x=x, y=y)} AS corr FROM {source}" for x in cols for y in cols if x != y
    )


_PEARSON = _matrix_sql("round(corr({x}, {y}), 9)", "features", B.FEATURE_COLS)


@query("h01_pearson", B.sql(B.FEATURES, body=_PEARSON))
def _(t):
    return ST.pearson(B.features(t), B.FEATURE_COLS).withColumn("corr", F.round("corr", 9))


@query("h01_correlated_with", B.sql(B.FEATURES, f"m AS ({_PEARSON})", body="SELECT * FROM m WHERE x IN ('price', 'tax') AND abs(corr) >= 0.001"))
def _(t):
    out = ST.correlated_with(ST.pearson(B.features(t), B.FEATURE_COLS), ["price", "tax"], 0.001)
    return out.withColumn("corr", F.round("corr", 9))


@query("h04_pairs_over", B.sql(B.FEATURES, f"m AS ({_PEARSON})", body="SELECT * FROM m WHERE x < y AND abs(corr) > 0.002"))
def _(t):
    return ST.pairs_over(ST.pearson(B.features(t), B.FEATURE_COLS), 0.002).withColumn("corr", F.round("corr", 9))


_RANKS = "ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in B.FEATURE_COLS
) + " FROM features)"


@query("h02_spearman", B.sql(B.FEATURES, _RANKS, body=_matrix_sql("round(corr({x}, {y}), 9)", "ranks", B.FEATURE_COLS)))
def _(t):
    return ST.spearman(B.features(t), B.FEATURE_COLS).withColumn("corr", F.round("corr", 9))


_KCOLS = ["quantity", "discount", "tax"]


def _kendall_sql(x: str, y: str) -> str:
    c = f"(SELECT {x} AS a, {y} AS b, count(*) AS n FROM features GROUP BY 1, 2)"
    return f"""SELECT '{x}' AS x, '{y}' AS y, round((SELECT sum(CAST(p.n AS DOUBLE) * q.n * sign(p.a - q.a) * sign(p.b - q.b)) / 2 FROM {c} p, {c} q)
    / sqrt(((SELECT count(*) * (count(*) - 1) / 2.0 FROM features) - (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM features GROUP BY {x})))
    * ((SELECT count(*) * (count(*) - 1) / 2.0 FROM features) - (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM features GROUP BY {y})))), 9) AS corr"""


_KENDALL = " UNION ALL ".join(_kendall_sql(x, y) for x in _KCOLS for y in _KCOLS if x != y)


@query("h03_kendall", B.sql(B.FEATURES, body=_KENDALL))
def _(t):
    return ST.kendall(B.features(t), _KCOLS).withColumn("corr", F.round("corr", 9))


@query("h03_kendall_median", B.sql(B.FEATURES, f"m AS ({_KENDALL})", body="SELECT x, round(quantile_cont(abs(corr), 0.5), 7) AS median_abs FROM m GROUP BY x"))
def _(t):
    return ST.median_abs(ST.kendall(B.features(t), _KCOLS)).withColumn("median_abs", F.round("median_abs", 7))


_CHI2 = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(sum(pow(seen - n / total_n * total, 2) / (n / total_n * total)), 6) AS score FROM
    (SELECT *, sum(n) OVER () AS total_n, sum(seen) OVER () AS total FROM (SELECT label, CAST(count(*) AS DOUBLE) AS n, sum({c}) AS seen FROM features GROUP BY 1))"""
    for c in B.FEATURE_COLS
)


@query("h05_chi2_scores", B.sql(B.FEATURES, body=_CHI2))
def _(t):
    return ST.chi2_scores(B.features(t), B.FEATURE_COLS, "label").withColumn("score", F.round("score", 6))


@query("o07_k_best", B.sql(B.FEATURES, f"s AS ({_CHI2})", body="SELECT * FROM s ORDER BY score DESC LIMIT 2"))
def _(t):
    return ST.k_best(B.features(t), B.FEATURE_COLS, "label", 2).withColumn("score", F.round("score", 6))


_MW = """r AS (SELECT label, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY quantity) AS t FROM features),
s AS (SELECT CAST(sum(rk) FILTER (label) AS DOUBLE) AS r1, CAST(count(*) FILTER (label) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1, n - n1 AS n2 FROM s)"""


@query(
    "h06_mann_whitney",
    B.sql(
        B.FEATURES,
        _MW,
        body="SELECT u1, least(u1, n1 * n2 - u1) AS u, round((u1 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 8) AS z FROM u",
    ),
)
def _(t):
    out = ST.mann_whitney(B.features(t), "label", "quantity")
    return out.select("u1", "u", F.round("z", 8).alias("z"))


@query("h06_mann_whitney_p")
def _(t):
    return ST.mann_whitney(B.features(t), "label", "quantity")


_FR = """k AS (SELECT rf, xgb, cat FROM predictions),
r AS (SELECT CAST((xgb < rf)::INT + (cat < rf)::INT + (1 + (xgb = rf)::INT + (cat = rf)::INT + 1) / 2.0 AS DOUBLE) AS a,
  CAST((rf < xgb)::INT + (cat < xgb)::INT + (1 + (rf = xgb)::INT + (cat = xgb)::INT + 1) / 2.0 AS DOUBLE) AS b,
  CAST((rf < cat)::INT + (xgb < cat)::INT + (1 + (rf = cat)::INT + (xgb = cat)::INT + 1) / 2.0 AS DOUBLE) AS c,
  CASE WHEN rf = xgb AND rf = cat THEN 24 ELSE 6 END AS ties FROM k)"""


@query(
    "h07_friedman",
    B.sql(
        B.PREDICTIONS,
        _FR,
        body="""SELECT round((12.0 / 12 * (pow(sum(a), 2) + pow(sum(b), 2) + pow(sum(c), 2)) / count(*) - 12 * count(*)) / (1 - sum(ties) / (count(*) * 24.0)), 6) AS chi2, CAST(2 AS INTEGER) AS dof FROM r""",
    ),
)
def _(t):
    out = ST.friedman(B.predictions(t), ["rf", "xgb", "cat"])
    return out.select(F.round("chi2", 6).alias("chi2"), "dof")


@query(
    "h08_share_interval",
    B.sql(
        B.FEATURES,
        "p AS (SELECT weekday, avg(CAST(label AS INTEGER)) AS p, count(*) AS n FROM features GROUP BY 1)",
        body="SELECT weekday, round(p - 0.975 * sqrt(p * (1 - p) / n), 9) AS low, round(p + 0.975 * sqrt(p * (1 - p) / n), 9) AS high FROM p",
    ),
)
def _(t):
    shares = B.features(t).groupBy("weekday").agg(F.avg(F.col("label").cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    low, high = ST.share_interval(F.col("p"), 0.05, F.col("n"))
    return shares.select("weekday", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))
