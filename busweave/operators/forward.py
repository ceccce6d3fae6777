"""Walk-forward least squares: all origins out of one pass over the rows.

Every row belongs to the stretch between two origins. The sums that the normal equations need are taken per stretch;
an origin's training rows are all stretches before it, so that its equations are a running sum of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def _stretch(origin: str, origins: Sequence) -> Column:
    """Number of origins at or before the row: 0 before the first one, null where the row has none."""
    reached = F.filter(F.array(*[F.lit(o) for o in origins]), lambda o: o <= F.col(origin))
    return F.when(F.col(origin).isNotNull(), F.size(reached))


def stretch_sums(df: DataFrame, cols: Sequence[str], label: str, shift: Sequence[float]) -> DataFrame:
    """``stretch, i, j, value``: sums of products of (1, features, what is missing of them, label), per stretch.

    Features and label are taken relative to ``shift``, missing features as 0. Each task keeps one matrix per stretch.
    """
    p = len(cols)
    centred = [F.when(_missing(c), 0.0).otherwise(F.col(c).cast("double") - s).alias(f"x{i}") for i, (c, s) in enumerate(zip(cols, shift))]
    absent = [_missing(c).cast("double").alias(f"u{i}") for i, c in enumerate(cols)]
    rows = df.where(~_missing(label)).select("stretch", F.lit(1.0).alias("one"), *centred, *absent, (F.col(label).cast("double") - shift[p]).alias("y"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            number, values = part["stretch"].to_numpy(), part.drop(columns="stretch").to_numpy(float)
            for k in np.unique(number):
                some = values[number == k]
                sums[int(k)] = sums.get(int(k), 0) + some.T @ some
        for k, matrix in sums.items():
            i, j = np.indices(matrix.shape)
            yield pd.DataFrame({"stretch": k, "i": i.ravel(), "j": j.ravel(), "value": matrix.ravel()})

    summed = rows.mapInPandas(run, "stretch int, i int, j int, value double")
    return summed.groupBy("stretch", "i", "j").agg(F.sum("value").alias("value"))


def _solve(sums: np.ndarray, p: int) -> tuple[list[float], float, list[float]]:
    """Coefficients, intercept and means, all relative to the shift; missing features count as the mean of the known."""
    n, total, absent = sums[0, 0], sums[0, 1 : p + 1], sums[0, p + 1 : 2 * p + 1]
    means = np.divide(total, n - absent, out=np.zeros(p), where=n > absent)
    # Each feature as a combination of (1, features, missing, label), centred by its mean; the label by its own.
    centred = np.zeros((p + 1, 2 * p + 2))
    centred[:p, 0], centred[:p, 1 : p + 1], centred[:p, p + 1 : 2 * p + 1] = -means, np.eye(p), np.diag(means)
    centred[p, 0], centred[p, -1] = -sums[0, -1] / n, 1
    products = centred @ sums @ centred.T
    scale = np.sqrt(np.where(np.diag(products)[:p] > 0, np.diag(products)[:p], 1))
    scaled = np.linalg.lstsq(products[:p, :p] / np.outer(scale, scale), products[:p, p] / scale, rcond=1e-12)[0]
    weights = scaled / scale
    return weights.tolist(), float(sums[0, -1] / n - weights @ means), means.tolist()


def origin_models(df: DataFrame, cols: Sequence[str], label: str, origin: str, origins: Sequence) -> DataFrame:
    """``stretch, coefficients, intercept, means, rows``: least squares of the labelled rows before each origin.

    ``origins`` are few values in ascending order; stretch 1 is what follows the first. Missing features (null or NaN)
    take the mean of the origin's training rows. A feature that does not vary gets no weight. Origins without a
    training row are left out. Only sums, a bounded number per origin, reach the driver.
    """
    ordered, p = list(origins), len(cols)
    if ordered != sorted(set(ordered)):
        raise ValueError("origins must ascend")
    known = df.withColumn("stretch", _stretch(origin, ordered)).where("stretch IS NOT NULL")
    middles = known.agg(*[F.avg(F.when(~_missing(c), F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate([*cols, label])]).first()
    shift = [m or 0.0 for m in middles]
    per_stretch = np.zeros((len(ordered) + 1, 2 * p + 2, 2 * p + 2))
    for k, i, j, value in stretch_sums(known.where(F.col("stretch") < len(ordered)), cols, label, shift).collect():
        per_stretch[k, i, j] = value
    models, shifts = [], np.array(shift[:p])
    for k, sums in enumerate(np.cumsum(per_stretch, axis=0)[:-1], start=1):
        if sums[0, 0] > 0:
            weights, intercept, means = _solve(sums, p)
            models.append((k, weights, intercept + shift[p] - float(np.dot(weights, shifts)), (np.array(means) + shifts).tolist(), int(sums[0, 0])))
    return df.sparkSession.createDataFrame(models, "stretch int, coefficients array<double>, intercept double, means array<double>, rows long")


def walk_forward_ols(df: DataFrame, cols: Sequence[str], label: str, origin: str, origins: Sequence) -> DataFrame:
    """Rows at or after the first origin with ``prediction`` by the model of the last origin before them.

    The prediction is null where no row comes before the origin. Rows whose origin is null are left out.
    """
    models = origin_models(df, cols, label, origin, origins).select("stretch", "coefficients", "intercept", "means")
    asked = df.drop("prediction").withColumn("stretch", _stretch(origin, list(origins))).where("stretch > 0")
    filled = F.array(*[F.when(_missing(c), F.element_at("means", i)).otherwise(F.col(c).cast("double")) for i, c in enumerate(cols, start=1)])
    products = F.zip_with(filled, "coefficients", lambda a, b: a * b)
    prediction = F.aggregate(products, F.col("intercept"), lambda s, x: s + x).alias("prediction")
    return asked.join(models, "stretch", "left").select(*[c for c in df.columns if c != "prediction"], prediction)
