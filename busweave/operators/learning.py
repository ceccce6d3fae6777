"""Models on MLlib: fits, sweeps, ensembles, forecasts and their inspection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, MinMaxScaler, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busweave.operators.features import row_hash
from busweave.operators.forward import walk_forward_ols
from busweave.operators.profile import error_weights
from busweave.session import checkpointed

SEED = 42

CLASSIFIERS = {
    "random_forest": lambda **p: RandomForestClassifier(**{"numTrees": 20, "seed": SEED, **p}),
    "boosted_trees": lambda **p: GBTClassifier(**{"maxIter": 10, "seed": SEED, **p}),
    "logistic": lambda **p: LogisticRegression(**p),
    "tree": lambda **p: DecisionTreeClassifier(**{"seed": SEED, **p}),
    "linear_svm": lambda **p: LinearSVC(**{"maxIter": 20, **p}),
    "perceptron": lambda **p: MultilayerPerceptronClassifier(**{"maxIter": 30, "seed": SEED, **p}),
}

REGRESSORS = {
    "ols": lambda **p: LinearRegression(**{"solver": "normal", **p}),
    "ridge": lambda **p: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.0, **p}),
    "lasso": lambda **p: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 1.0, **p}),
    "elastic_net": lambda **p: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.5, **p}),
    "huber": lambda **p: LinearRegression(**{"loss": "huber", "maxIter": 50, **p}),
    "random_forest": lambda **p: RandomForestRegressor(**{"numTrees": 20, "seed": SEED, **p}),
}


def assemble(cols: Sequence[str], out: str = "features") -> Pipeline:
    """Mean of the training rows for null and NaN features, then one vector; every row stays."""
    filled = [f"__filled_{c}" for c in cols]
    means = Imputer(inputCols=list(cols), outputCols=filled, strategy="mean")
    return Pipeline(stages=[means, VectorAssembler(inputCols=filled, outputCol=out, handleInvalid="error")])


def vector_slice(indices: Sequence[int], source: str = "features", out: str = "sliced") -> VectorSlicer:
    return VectorSlicer(inputCol=source, outputCol=out, indices=list(indices))


def scale_pipeline(cols: Sequence[str], kind: str = "standard") -> Pipeline:
    """Assemble and scale as pipeline steps."""
    scaler = (
        StandardScaler(inputCol="raw", outputCol="features", withMean=True)
        if kind == "standard"
        else MinMaxScaler(inputCol="raw", outputCol="features")
    )
    return Pipeline(stages=[assemble(cols, "raw"), scaler])


def _with_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double"))


def fit_classifier(df: DataFrame, cols: Sequence[str], label: str, kind: str, **params):
    """Fitted pipeline: assembler and classifier."""
    return Pipeline(stages=[assemble(cols), _classifier(cols, kind, params)]).fit(_with_label(df, label))


def _classifier(cols: Sequence[str], kind: str, params: dict):
    if kind == "perceptron":
        params = {"layers": [len(cols), 8, 2], **params}
    return CLASSIFIERS[kind](labelCol="label", featuresCol="features", **params)


def fit_regressor(df: DataFrame, cols: Sequence[str], label: str, kind: str, **params):
    model = REGRESSORS[kind](labelCol="label", featuresCol="features", **params)
    return Pipeline(stages=[assemble(cols), model]).fit(_with_label(df, label))


def predict(model, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Rows with the model's prediction, without its helper columns."""
    out = model.transform(df.drop("label"))
    keep = [c for c in df.columns if c != "label"]
    return out.select(*keep, F.col("prediction").alias(name))


def fit_steps(df: DataFrame, cols: Sequence[str], labels: Sequence[str], kind: str, **params) -> dict:
    """One model per label column. Rows are read and prepared once and written; every fit goes over what is written."""
    prepare = assemble(cols).fit(df)
    others = [c for c in (params.get("weightCol"),) if c]
    steps = {label: f"__y{i}" for i, label in enumerate(labels)}
    made = prepare.transform(df).select("features", *others, *[F.col(c).cast("double").alias(y) for c, y in steps.items()])
    ready = checkpointed(made, "steps")
    fit = lambda y: _classifier(cols, kind, params).fit(ready.select("features", *others, F.col(y).alias("label")))
    return {label: PipelineModel([prepare, fit(y)]) for label, y in steps.items()}


def predict_steps(models: dict, df: DataFrame) -> DataFrame:
    out = df
    for label, model in models.items():
        out = predict(model, out, f"pred_{label}")
    return out


def fit_slices(frames: Sequence[DataFrame], cols: Sequence[str], label: str, kind: str, **params) -> list:
    """Continued training: one model per new slice of data. MLlib cannot warm-start its ensembles, so
    the slices' models are combined at prediction time."""
    return [fit_classifier(f, cols, label, kind, **params) for f in frames]


def predict_slices(models: Sequence, df: DataFrame) -> DataFrame:
    """Mean probability of the positive class over the slice models, and the label from it."""
    out, names = df.drop("label"), []
    for i, model in enumerate(models):
        name = f"__p{i}"
        scored = model.transform(out)
        out = scored.select(*out.columns, vector_to_array("probability")[1].alias(name))
        names.append(name)
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
    return out.withColumn("score", mean).withColumn("prediction", (F.col("score") >= 0.5).cast("int")).drop(*names)


def grid_search(df: DataFrame, cols: Sequence[str], label: str, kind: str, grid: dict, folds: int = 3, metric: str = "f1", beta: float = 1.0):
    """Cross-validated grid; returns the fitted cross-validator model and its parameter maps."""
    estimator = CLASSIFIERS[kind](labelCol="label", featuresCol="features")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    if metric == "f_beta":
        evaluator = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, beta=beta)
    else:
        evaluator = MulticlassClassificationEvaluator(metricName=metric)
    rows = _with_label(df, label)
    data = assemble(cols).fit(rows).transform(rows).select("features", "label")
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, seed=SEED, parallelism=4)
    return cv.fit(data), maps


def sweep(df: DataFrame, cols: Sequence[str], label: str, kind: str, param: str, values: Sequence, folds: int = 3) -> DataFrame:
    """Mean cross-validation score per value of one parameter, the best one marked."""
    model, maps = grid_search(df, cols, label, kind, {param: values}, folds)
    rows = [(float(v), float(s)) for v, s in zip(values, model.avgMetrics)]
    best = max(range(len(rows)), key=lambda i: rows[i][1])
    return df.sparkSession.createDataFrame([(v, s, i == best) for i, (v, s) in enumerate(rows)], f"{param} double, score double, best boolean")


def stack(
    df: DataFrame, cols: Sequence[str], label: str, kinds: Sequence[str], key: str, train: str | None = None, folds: int = 3, params: dict | None = None
) -> DataFrame:
    """``df`` with ``pred_<kind>`` per learner; each sees the features and the predictions of the learners before it.

    Training rows (those where ``train`` holds, else all) are dealt to folds by a hash of ``key``, and a row's
    predictions come from models fitted to the other folds, so that no input of a later learner comes from a model
    that saw the row. The other rows are predicted by models of all training rows. Rows of equal key share a fold, null
    keys too; ``train`` is false where it is null.
    """
    params, own = params or {}, [c for c in df.columns if not c.startswith("pred_")]
    fold = F.coalesce(row_hash(key) % folds, F.lit(0))
    trains = F.coalesce(F.expr(train).cast("boolean"), F.lit(False)) if train else F.lit(True)
    out = checkpointed(df.select(*own, F.when(trains, fold).alias("__fold")), "stack")
    inputs = list(cols)
    for kind in kinds:
        name, parts = f"pred_{kind}", []
        learn = lambda rows: fit_classifier(rows, inputs, label, kind, **params.get(kind, {}))  # noqa: B023, E731
        for f in range(folds):
            asked = out.where(F.col("__fold") == f)
            if not asked.isEmpty():
                parts.append(_predicted(learn(out.where(F.col("__fold") != f)), asked, name))
        if train:
            parts.append(_predicted(learn(out.where("__fold IS NOT NULL")), out.where("__fold IS NULL"), name))
        out = checkpointed(reduce(DataFrame.unionByName, parts), "stack")
        inputs.append(name)
    return out.drop("__fold")


def _predicted(model, df: DataFrame, name: str) -> DataFrame:
    """Rows with the model's prediction, the label column kept."""
    return model.transform(df).select(*df.columns, F.col("prediction").alias(name))


def boost_by_errors(df: DataFrame, cols: Sequence[str], label: str, kinds: Sequence[str], train: str | None = None) -> DataFrame:
    """Each learner sees the predictions of those before it and is weighted by the last one's errors.

    Learners are fitted to the rows where ``train`` holds, else to all; every row is predicted. Rows are written before
    the first learner and after each, so that no pass of a fit goes through the models before it or makes its rows anew.
    """
    out, weight, inputs = checkpointed(df, "boost"), None, list(cols)
    for kind in kinds:
        params = {"weightCol": "weight"} if weight else {}
        model = fit_classifier(out.where(train) if train else out, list(inputs), label, kind, **params)
        name = f"pred_{kind}"
        inputs.append(name)
        keep = [c for c in out.columns if c != "weight"]
        out = predict(model, out.select(*keep).withColumn("__y", F.col(label)).drop("label"), name)
        out = out.withColumn(label, F.col("__y")).drop("__y")
        weight = error_weights(out.withColumn("__l", F.col(label).cast("int")), "__l", name).drop("__l")
        out = checkpointed(weight, "boost")
    return out


def importances(model, cols: Sequence[str], df: DataFrame, n: int = 20) -> DataFrame:
    """Feature importances by name, largest first. A model has one number per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(cols, map(float, values)), key=lambda r: (-r[1], r[0]))[:n]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def p_values(df: DataFrame, cols: Sequence[str], label: str, family: str = "gaussian", level: float = 0.05) -> DataFrame:
    """P value of every coefficient and whether it is significant, smallest first."""
    rows = _with_label(df, label)
    data = assemble(cols).fit(rows).transform(rows).select("features", "label")
    if family == "gaussian":
        model = LinearRegression(solver="normal").fit(data)
    else:
        model = GeneralizedLinearRegression(family=family).fit(data)
    names = [*cols, "intercept"]
    rows = sorted(zip(names, map(float, model.summary.pValues)), key=lambda r: r[1])
    return df.sparkSession.createDataFrame([(n, p, p <= level) for n, p in rows], "feature string, p_value double, significant boolean")


def nonzero_coefficients(model, df: DataFrame) -> DataFrame:
    values = model.stages[-1].coefficients.toArray()
    n = int((values != 0).sum())
    return df.sparkSession.createDataFrame([(n, len(values) - n)], "nonzero int, zero int")


#: Share of Poisson(1) counts of at most 0, 1, ... 12.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def bootstrap(df: DataFrame, key: str, seeds: Sequence[int]) -> DataFrame:
    """Resamples with replacement, one per seed, told apart by ``sample``; how often a row is drawn follows from its key."""
    drawn = F.shiftrightunsigned(F.xxhash64(key, "sample"), 11) / float(1 << 53)
    times = sum((F.when(drawn >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    spread = df.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return spread.withColumn("__times", times).where("__times > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times", "__nth")


def sample_sizes(samples: DataFrame, key: str, seeds: Sequence[int]) -> DataFrame:
    """Rows and distinct known keys of each resample of ``bootstrap``; samples without rows have no row here.

    Draws are counted per key first, for all samples at once: the copies of a row lie side by side, so that a key
    is shuffled once and not once for each sample it is in.
    """
    drawn = [F.count_if(F.col("sample") == s).alias(f"__n{i}") for i, s in enumerate(seeds)]
    per_key = samples.groupBy(key).agg(*drawn)
    counts = F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"__n{i}").alias("n")) for i, s in enumerate(seeds)])
    listed = per_key.select(F.col(key).alias("__key"), F.inline(counts)).where("n > 0")
    return listed.groupBy("sample").agg(F.sum("n").alias("rows"), F.count("__key").alias("distinct_rows"))


def regression_scores(df: DataFrame, label: str = "label") -> dict[str, float]:
    return {
        m: RegressionEvaluator(labelCol=label, metricName=m).evaluate(df) for m in ("rmse", "r2", "mae")
    }


def recursive_forecast(df: DataFrame, history: str, coefficients: Sequence[float], intercept: float, steps: int, name: str = "forecast") -> DataFrame:
    """Forecast ``steps`` values with a linear model of the last values (oldest first), each forecast
    becoming the newest input of the next one. Runs inside each row on its bounded history array."""
    n = len(coefficients)
    weights = F.array(*[F.lit(float(c)) for c in coefficients])

    def step(acc, _):
        window = F.slice(acc, -n, n)
        value = F.aggregate(F.zip_with(window, weights, lambda a, b: a * b), F.lit(float(intercept)), lambda s, x: s + x)
        return F.concat(acc, F.array(value))

    start = F.slice(F.col(history).cast("array<double>"), -n, n)
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return df.withColumn(name, F.slice(grown, n + 1, steps))


def walk_forward(df: DataFrame, cols: Sequence[str], label: str, origin: str, origins: Sequence, kind: str = "ols") -> DataFrame:
    """Refit before each origin on all rows before it, predict the rows of that origin.

    Least squares take one pass for all origins; other kinds are fitted anew before each of a few.
    """
    if kind == "ols":
        return walk_forward_ols(df, cols, label, origin, origins)
    out = None
    ordered = list(origins)
    for i, o in enumerate(ordered):
        model = fit_regressor(df.where(F.col(origin) < o), cols, label, kind)
        upper = F.lit(True) if i + 1 == len(ordered) else F.col(origin) < ordered[i + 1]
        part = model.transform(df.where((F.col(origin) >= o) & upper)).select(*df.columns, F.col("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


def hash_fold(df: DataFrame, key: str, folds: int) -> DataFrame:
    return df.withColumn("fold", row_hash(key) % folds)
