"""Queries: models, ensembles, forecasts. Fits have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from busweave.operators import continued as C
from busweave.operators import learning as L
from busweave.operators import neighbours as N
from busweave.operators import profile as P
from busweave.operators.adaboost import fit_adaboost, predict_adaboost
from busweave.operators.features import split
from busweave.operators.forward import origin_models
from busweave.operators.series import sliding_frame
from busweave.operators.ordered import hours
from busweave.plans import bindings as B
from busweave.plans.registry import query

COLS = B.FEATURE_COLS


def _split_rows(t, *cols):
    """Rows split for training, with the columns that are asked for."""
    return split(_rows(t).drop("label"), "row_id", 0.8).select("is_train", *cols)


def _rows(t):
    return B.features(t).select("row_id", *COLS, F.col("label").cast("int").alias("label"), "weekday", "ts").withColumn(
        "y", (F.col("quantity") > 25).cast("int")
    )


_KNN = """near AS (SELECT a.vec_id AS test_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS place
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id)"""


@query(
    "m18_knn_vote",
    B.sql(
        _KNN,
        "votes AS (SELECT test_id, label, count(*) AS n FROM near WHERE place <= 5 GROUP BY 1, 2)",
        body="SELECT test_id, arg_min(label, (-n, label)) AS prediction FROM votes GROUP BY test_id",
    ),
)
def _(t):
    return N.knn_vote(t.embeddings, t.embeddings, "vec_id", "embedding", "label", 5, leave_self_out=True)


@query(
    "m18_knn_vote_far_from_origin",
    B.sql(
        _KNN.replace("embedding::DOUBLE[]", "list_transform(embedding, lambda x: x::DOUBLE + 1000)"),
        "votes AS (SELECT test_id, label, count(*) AS n FROM near WHERE place <= 5 GROUP BY 1, 2)",
        body="SELECT test_id, arg_min(label, (-n, label)) AS prediction FROM votes GROUP BY test_id",
    ),
)
def _(t):
    moved = t.embeddings.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + 1000))
    return N.knn_vote(moved, moved, "vec_id", "embedding", "label", 5, leave_self_out=True)


_PLACED = "SELECT c_custkey AS id, c_acctbal / 1000.0::DOUBLE AS x, c_nationkey::DOUBLE AS y, c_mktsegment AS segment FROM customer"


@query(
    "m18_knn_customers",
    f"""WITH c AS ({_PLACED}),
    near AS (SELECT a.id AS test_id, unnest(min((sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id, b.segment), 5)) AS n FROM c a JOIN c b ON a.id <> b.id GROUP BY a.id),
    votes AS (SELECT test_id, struct_extract(n, 3) AS segment, count(*) AS n FROM near GROUP BY 1, 2)
    SELECT test_id, arg_min(segment, (-n, segment)) AS prediction FROM votes GROUP BY test_id""",
)
def _(t):
    features = F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double"))
    rows = t.customer.select("c_custkey", features.alias("features"), F.col("c_mktsegment").alias("segment"))
    return N.knn_vote(rows, rows, "c_custkey", "features", "segment", 5, leave_self_out=True)


def _metrics(df, label, pred):
    out = P.class_metrics(df.withColumn(pred, F.col(pred).cast("int")), label, pred)
    return out.select(F.lit(pred).alias("model"), *out.columns)


def _classifier(kind):
    def build(t):
        rows = split(_rows(t), "row_id", 0.8)
        cols = ["price", "discount", "tax"]
        model = L.fit_classifier(rows.where("is_train"), cols, "y", kind)
        return _metrics(L.predict(model, rows.where("NOT is_train"), kind), "y", kind)

    return build


for _kind in L.CLASSIFIERS:
    query(f"m12_classifier_{_kind}")(_classifier(_kind))


@query("m12_adaboost")
def _(t):
    rows = split(_rows(t), "row_id", 0.8)
    vote = fit_adaboost(rows.where("is_train"), ["price", "discount", "tax"], "y", rounds=5)
    return _metrics(predict_adaboost(vote, rows.where("NOT is_train"), "adaboost"), "y", "adaboost")


# With one feature of two values a stump gives each value its weightier label: four weights say everything.
_BOOST_ROUNDS, _BOOST_RATE = 4, 0.5


@query(
    "m12_adaboost_rounds",
    f"""WITH RECURSIVE r AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS x, CAST(l_quantity + CASE WHEN l_returnflag = 'R' THEN 12 ELSE 0 END > 25 AS INTEGER) AS y FROM lineitem),
    c AS (SELECT x, count(*) FILTER (y = 0)::DOUBLE AS w0, count(*) FILTER (y = 1)::DOUBLE AS w1 FROM r GROUP BY x),
    s AS (SELECT 0 AS round, max(w0) FILTER (x = 0) AS a0, max(w1) FILTER (x = 0) AS a1, max(w0) FILTER (x = 1) AS b0, max(w1) FILTER (x = 1) AS b1, NULL::DOUBLE AS err, NULL::DOUBLE AS alpha FROM c
      UNION ALL SELECT round + 1, CASE WHEN a0 < a1 THEN a0 * exp(alpha) ELSE a0 END, CASE WHEN a1 <= a0 THEN a1 * exp(alpha) ELSE a1 END,
        CASE WHEN b0 < b1 THEN b0 * exp(alpha) ELSE b0 END, CASE WHEN b1 <= b0 THEN b1 * exp(alpha) ELSE b1 END, err, alpha
      FROM (SELECT round, a0, a1, b0, b1, (least(a0, a1) + least(b0, b1)) / (a0 + a1 + b0 + b1) AS err,
              {_BOOST_RATE}::DOUBLE * ln(1 / ((least(a0, a1) + least(b0, b1)) / (a0 + a1 + b0 + b1)) - 1) AS alpha FROM s WHERE round < {_BOOST_ROUNDS}))
    SELECT round, round(err, 6) AS err, round(alpha, 6) AS alpha FROM s WHERE round > 0""",
)
def _(t):
    returned = F.col("l_returnflag") == "R"
    rows = t.lineitem.select(returned.cast("int").alias("x"), (F.col("l_quantity") + F.when(returned, 12).otherwise(0) > 25).cast("int").alias("y"))
    vote = fit_adaboost(rows, ["x"], "y", rounds=_BOOST_ROUNDS, rate=_BOOST_RATE)
    measured = [(i, round(e, 6), round(a, 6)) for i, (e, a) in enumerate(zip(vote.errors, vote.alphas), 1)]
    return t.spark.createDataFrame(measured, "round int, err double, alpha double")


def _regressor(kind):
    def build(t):
        rows = split(_rows(t), "row_id", 0.8)
        model = L.fit_regressor(rows.where("is_train"), ["price", "discount", "tax"], "quantity", kind)
        return P.regression_metrics(L.predict(model, rows.where("NOT is_train")), "quantity", "prediction")

    return build


for _kind in L.REGRESSORS:
    query(f"m14_regressor_{_kind}")(_regressor(_kind))


_STD = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in COLS)


@query("m05_scale_pipeline", B.sql(B.FEATURES, body=f"SELECT row_id, {_STD} FROM features"))
def _(t):
    from pyspark.ml.functions import vector_to_array

    rows = _rows(t)
    out = L.scale_pipeline(COLS).fit(rows).transform(rows)
    v = vector_to_array("features")
    return out.select("row_id", *[F.round(v[i], 6).alias(c) for i, c in enumerate(COLS)])


@query("p13_vector_slice", B.sql(B.FEATURES, body="SELECT row_id, price, tax FROM features"))
def _(t):
    from pyspark.ml.functions import vector_to_array

    out = L.vector_slice([1, 3]).transform(L.assemble(COLS).fit(_rows(t)).transform(_rows(t)))
    v = vector_to_array("sliced")
    return out.select("row_id", v[0].alias("price"), v[1].alias("tax"))


@query("m10_grid_search")
def _(t):
    model, maps = L.grid_search(_rows(t), ["price", "discount", "tax"], "y", "tree", {"maxDepth": [2, 4]}, folds=2, metric="f_beta", beta=0.5)
    rows = [(int(list(m.values())[0]), float(s)) for m, s in zip(maps, model.avgMetrics)]
    return t.spark.createDataFrame(rows, "max_depth int, score double")


@query("m11_sweep")
def _(t):
    return L.sweep(_rows(t), ["price", "discount", "tax"], "y", "tree", "maxDepth", [1, 3, 5], folds=2)


@query("m13_fit_slices")
def _(t):
    slices, held_out = _slices(_rows(t))
    models = L.fit_slices(slices, ["price", "discount", "tax"], "y", "tree")
    return _metrics(L.predict_slices(models, held_out), "y", "prediction")


def _slices(rows):
    """Half of the rows, twice a fifth, and a tenth that no fit sees."""
    folds = L.hash_fold(rows, "row_id", 10)
    return [folds.where("fold < 5"), folds.where("fold IN (5, 6)"), folds.where("fold IN (7, 8)")], folds.where("fold = 9")


def _continued(fit, **params):
    def build(t):
        slices, held_out = _slices(_rows(t))
        chains = C.continue_slices(slices, fit, ["price", "discount", "tax"], "y", **params)
        parts = [_metrics(C.predict_chain(chain, held_out), "y", "prediction").withColumn("slices", F.lit(i)) for i, chain in enumerate(chains, 1)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return build


query("m13_continued_boosting")(_continued(C.continue_boosting, rounds=3, depth=3))
query("m13_continued_logistic")(_continued(C.continue_logistic))

# With one feature of two values a tree is a split between them: each value's margin follows a recursion of its own.
_STUMP_ROUNDS, _STUMP_RATE = 2, 0.3


@query(
    "m13_continued_stumps",
    f"""WITH RECURSIVE r AS (SELECT {B.ROW_KEY} AS row_id, CAST(l_returnflag = 'R' AS INTEGER) AS x,
      CAST(l_quantity + CASE WHEN l_returnflag = 'R' THEN 12 ELSE 0 END > 25 AS INTEGER) AS y FROM lineitem),
    f AS (SELECT *, CAST('0x' || substr(md5(row_id), 1, 8) AS BIGINT) % 10 AS fold FROM r),
    g AS (SELECT x, CASE WHEN fold < 5 THEN 1 WHEN fold < 7 THEN 2 ELSE 3 END AS slice, avg(y) AS share FROM f WHERE fold < 9 GROUP BY ALL),
    s AS (SELECT ln((sum(y) + 0.5::DOUBLE) / (count(*) - sum(y) + 0.5::DOUBLE)) AS margin FROM f WHERE fold < 5),
    m AS (SELECT x, 0 AS step, margin FROM s, (VALUES (0), (1)) v(x)
      UNION ALL SELECT m.x, m.step + 1, m.margin + {_STUMP_RATE}::DOUBLE * (g.share - 1 / (1 + exp(-m.margin))) / ((1 / (1 + exp(-m.margin))) * (1 - 1 / (1 + exp(-m.margin))))
      FROM m JOIN g ON g.x = m.x AND g.slice = m.step // {_STUMP_ROUNDS} + 1)
    SELECT step // {_STUMP_ROUNDS} AS slices, x, round(margin, 6) AS margin, rows FROM m JOIN (SELECT x, count(*) AS rows FROM f WHERE fold = 9 GROUP BY x) USING (x)
    WHERE step > 0 AND step % {_STUMP_ROUNDS} = 0""",
)
def _(t):
    returned = F.col("l_returnflag") == "R"
    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_id"), returned.cast("int").alias("x"), (F.col("l_quantity") + F.when(returned, 12).otherwise(0) > 25).cast("int").alias("y"))
    slices, held_out = _slices(rows)
    chains = C.continue_slices(slices, C.continue_boosting, ["x"], "y", rounds=_STUMP_ROUNDS, rate=_STUMP_RATE, depth=1)
    parts = [C.predict_chain(chain, held_out).withColumn("slices", F.lit(i)) for i, chain in enumerate(chains, 1)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("slices", "x").agg(F.round(F.min("margin"), 6).alias("margin"), F.count(F.lit(1)).alias("rows"))


@query("m16_stack")
def _(t):
    rows = _split_rows(t, "row_id", "y", "price", "discount", "tax")
    out = L.stack(rows, ["price", "discount", "tax"], "y", ["random_forest", "tree", "logistic"], "row_id", train="is_train")
    return _metrics(out.where("NOT is_train"), "y", "pred_logistic")


@query("m17_boost_by_errors")
def _(t):
    rows = _split_rows(t, "y", "price", "discount", "tax")
    out = L.boost_by_errors(rows, ["price", "discount", "tax"], "y", ["tree", "random_forest", "logistic"], train="is_train")
    return _metrics(out.where("NOT is_train"), "y", "pred_logistic")


@query("m19_fit_steps")
def _(t):
    rows = _split_rows(t, "quantity", "price", "discount", "tax")
    steps = [f"step_{k}" for k in range(11)]
    rows = rows.withColumns({s: (F.col("quantity") > 4 * (k + 1)).cast("int") for k, s in enumerate(steps)})
    models = L.fit_steps(rows.where("is_train"), ["price", "discount", "tax"], steps, "tree", maxDepth=3)
    out = L.predict_steps(models, rows.where("NOT is_train"))
    return out.agg(*[F.avg((F.col(s) == F.col(f"pred_{s}")).cast("int")).alias(f"accuracy_{s}") for s in steps])


@query(
    "m23_recursive_forecast",
    """WITH h AS (SELECT event_id, value AS c, lag(value, 1) OVER w AS b, lag(value, 2) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    f1 AS (SELECT *, 1.5::DOUBLE + 0.2::DOUBLE * a + 0.3::DOUBLE * b + 0.4::DOUBLE * c AS p1 FROM h WHERE a IS NOT NULL),
    f2 AS (SELECT *, 1.5::DOUBLE + 0.2::DOUBLE * b + 0.3::DOUBLE * c + 0.4::DOUBLE * p1 AS p2 FROM f1),
    f3 AS (SELECT *, 1.5::DOUBLE + 0.2::DOUBLE * c + 0.3::DOUBLE * p1 + 0.4::DOUBLE * p2 AS p3 FROM f2)
    SELECT event_id, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM f3""",
)
def _(t):
    framed = sliding_frame(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], hours("ts", 86400), "value", 2)
    out = L.recursive_forecast(framed.withColumn("past", F.array("x_1", "x_2", "y")), "past", [0.2, 0.3, 0.4], 1.5, 3)
    return out.select("event_id", *[F.round(F.col("forecast")[i], 6).alias(f"p{i + 1}") for i in range(3)])


def _three(a):
    """Determinant of three rows of three SQL expressions."""
    return " + ".join(
        f"{sign}({a[0][i]}) * (({a[1][j]}) * ({a[2][k]}) - ({a[1][k]}) * ({a[2][j]}))" for i, j, k, sign in ((0, 1, 2, ""), (1, 0, 2, "-"), (2, 0, 1, ""))
    )


def _fits_sql(origins):
    """Least squares of quantity on price, discount and tax before each origin, by Cramer's rule on covariances."""
    x = ("price", "discount", "tax")
    named = ", ".join(f"covar_pop({a}, {b}) AS s{i}{j}" for i, a in enumerate(x) for j, b in enumerate((*x, "quantity")))
    s = [[f"s{i}{j}" for j in range(3)] for i in range(3)]
    swapped = [[[f"s{i}3" if j == k else s[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    slopes = ", ".join(f"({_three(swapped[k])}) / ({_three(s)}) AS b{k}" for k in range(3))
    values = ", ".join(f"({i}, '{o}')" for i, o in enumerate(origins, 1))
    return f"""origins AS (SELECT * FROM (VALUES {values}) v(k, o)),
    moments AS (SELECT k, count(*) AS n, avg(quantity) AS my, avg(price) AS m0, avg(discount) AS m1, avg(tax) AS m2, {named}
      FROM origins JOIN features ON strftime(ts, '%Y-%m-%d') < o GROUP BY k),
    fits AS (SELECT *, my - b0 * m0 - b1 * m1 - b2 * m2 AS b FROM (SELECT k, n, my, m0, m1, m2, {slopes} FROM moments)),
    predicted AS (SELECT f.quantity, b + b0 * price + b1 * discount + b2 * tax AS prediction
      FROM (SELECT *, (SELECT max(k) FROM origins WHERE o <= strftime(features.ts, '%Y-%m-%d')) AS k FROM features) f JOIN fits USING (k))"""


_ORIGINS = ["1997-01-01", "1999-01-01"]
_MANY_ORIGINS = [f"{year}-{month:02d}-01" for year in range(1996, 2001) for month in (1, 4, 7, 10)]
_ROUNDED = "round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (var_pop(quantity) * count(*)), 6) AS r2"


@query("m23_walk_forward", B.sql(B.FEATURES, _fits_sql(_ORIGINS), body=f"SELECT {_ROUNDED} FROM (SELECT *, quantity - prediction AS e FROM predicted)"))
def _(t):
    rows = _rows(t).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = L.walk_forward(rows, ["price", "discount", "tax"], "quantity", "day", _ORIGINS)
    scores = P.regression_metrics(out, "quantity", "prediction")
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


@query(
    "m23_origin_models",
    B.sql(B.FEATURES, _fits_sql(_MANY_ORIGINS), body="SELECT k AS stretch, n AS rows, round(b, 6) AS intercept, round(b0 * 1e6, 6) AS price, round(b1, 6) AS discount, round(b2, 6) AS tax FROM fits"),
)
def _(t):
    rows = _rows(t).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    models = origin_models(rows, ["price", "discount", "tax"], "quantity", "day", _MANY_ORIGINS)
    weight = lambda i: F.col("coefficients")[i]
    return models.select("stretch", "rows", F.round("intercept", 6).alias("intercept"), F.round(weight(0) * 1e6, 6).alias("price"), F.round(weight(1), 6).alias("discount"), F.round(weight(2), 6).alias("tax"))


@query("m26_importances")
def _(t):
    cols = ["price", "discount", "tax", "weekday"]
    return L.importances(L.fit_classifier(_rows(t), cols, "y", "random_forest"), cols, t.lineitem)


@query("m27_p_values")
def _(t):
    return L.p_values(_rows(t), ["price", "discount", "tax"], "quantity")


@query("m27_p_values_logistic")
def _(t):
    return L.p_values(_rows(t), ["price", "discount", "tax"], "y", "binomial")


@query("m28_nonzero_coefficients")
def _(t):
    rows = _rows(t)
    return L.nonzero_coefficients(L.fit_regressor(rows, ["price", "discount", "tax"], "quantity", "lasso"), rows)


@query("m30_bootstrap")
def _(t):
    seeds = [1, 2, 3, 4, 5, 6, 7]
    return L.sample_sizes(L.bootstrap(_rows(t).select("row_id", "label"), "row_id", seeds), "row_id", seeds)
