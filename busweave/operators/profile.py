"""Counts, shares, rates, histograms and confusion tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busweave.functions.times import weekday_name
from busweave.operators.quantiles import exact_quantiles


def rate_by(df: DataFrame, flag: str, by: Sequence[str], name: str = "rate") -> DataFrame:
    """Share of rows whose flag is set, per group."""
    return df.groupBy(*by).agg(F.avg(F.col(flag).cast("int")).alias(name))


def mean_rate(df: DataFrame, flag: str, by: Sequence[str]) -> DataFrame:
    """Mean and exact median of the group rates."""
    rates = rate_by(df, flag, by)
    mean = rates.agg(F.lit("rate").alias("feature"), F.avg("rate").alias("mean_rate"))
    median = exact_quantiles(rates, ["rate"], {"median_rate": 0.5})
    return mean.join(median, "feature").drop("feature")


def buses_per_route(df: DataFrame, route: str = "route", bus: str = "bus", day: str = "day") -> DataFrame:
    """Distinct buses per route and day, their mean per route and the mean of the means."""
    daily = df.select(route, day, bus).distinct().groupBy(route, day).agg(F.count(F.lit(1)).alias("n"))
    per_route = daily.groupBy(route).agg(F.avg("n").alias("mean_buses"))
    return per_route.agg(F.avg("mean_buses").alias("mean_buses_per_route"))


def coverage(df: DataFrame, column: str, default, by: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Share of rows whose ``column`` is not the default; groups without rows count as 0."""
    hit = F.avg((F.col(column) != F.lit(default)).cast("int")).alias("coverage")
    if by is None:
        return df.agg(hit)
    found = df.groupBy(by).agg(hit)
    if groups is None:
        return found
    return groups.select(by).distinct().join(found, by, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def argmax_group(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Key with the largest metric, the smallest key among ties."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col(key).alias("k")))
    return df.agg(best.alias("b")).select(F.col("b.k").alias(key), (-F.col("b.m")).alias(metric))


def trip_hit_share(df: DataFrame, flag: str, trip: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of trips with at least one hit, in all or per group."""
    trips = df.groupBy(*dict.fromkeys([*by, *trip])).agg(F.max(flag).alias("__hit"))
    share = F.avg(F.col("__hit").cast("int")).alias("share")
    return trips.groupBy(*by).agg(F.count(F.lit(1)).alias("trips"), share)


def weekday_share(df: DataFrame, flag: str, ts: str = "ts") -> DataFrame:
    """Hits per weekday and their share of all hits of the table."""
    hits = df.where(F.col(flag)).groupBy(weekday_name(F.col(ts)).alias("weekday")).agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("share", F.col("hits") / F.sum("hits").over(Window.partitionBy(F.lit(1))))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values per column. Each column is first made distinct on its own, spread by value."""
    longs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p")
    ).select("p.column", "p.v")
    return longs.where("v IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width counts between the minimum and the maximum, the last bin closed."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = 0.0 if low is None else float(high) - float(low)
    place = F.lit(0) if width == 0 else F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width * bins))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns(
            {"low": F.lit(low) + F.col("bin") * (width / bins), "high": F.lit(low) + (F.col("bin") + 1) * (width / bins)}
        )
    )


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: number of nulls and whether there is any; one pass for all columns."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])).alias("p")
    return one.select(pairs).select("p.column", "p.nulls", (F.col("p.nulls") > 0).alias("any_null"))


def class_share(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, nulls, minimum, maximum, mean and deviation of numeric columns in one pass."""
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("n"),
                F.count_if(v.isNull()).alias("nulls"),
                F.min(v).alias("low"),
                F.max(v).alias("high"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("deviation"),
            ).alias(f"__{c}")
        )
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[f"__{c}" for c in cols])).alias("p")).select("p.*")


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def daily_totals(df: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    """Sums per day; days without rows between the first and the last give 0."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(*[F.sum(c).alias(c) for c in cols])
    span = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(days, "day", "left").select("day", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols])


# --- predictions against labels ----------------------------------------------------------------


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Rows and share per (label, prediction)."""
    counts = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def confusion_matrix(df: DataFrame, label: str, pred: str, labels: Sequence) -> DataFrame:
    """One row per label, one count column per predicted label."""
    wide = df.groupBy(label).pivot(pred, list(labels)).count()
    return wide.select(label, *[F.coalesce(F.col(str(v)), F.lit(0)).alias(f"pred_{v}") for v in labels])


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    counts = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(
        F.array(
            F.struct(F.col(label).alias("cls"), F.lit(1).alias("is_label")),
            F.struct(F.col(pred).alias("cls"), F.lit(0).alias("is_label")),
        )
    ).alias("s")
    sums = (
        counts.select("n", (F.col(label) == F.col(pred)).alias("ok"), sides)
        .groupBy("s.cls")
        .agg(
            F.sum(F.when((F.col("s.is_label") == 1) & F.col("ok"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("s.is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("s.is_label") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        )
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return sums.select(
        "cls",
        "support",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
    )


def micro_average(df: DataFrame, label: str, pred: str, labels: Sequence) -> DataFrame:
    """Precision and recall pooled over the listed classes."""
    inside = lambda c: F.col(c).isin(list(labels))
    hit = F.count_if(inside(label) & (F.col(label) == F.col(pred)))
    return df.agg(
        F.try_divide(hit, F.count_if(inside(pred))).alias("precision"),
        F.try_divide(hit, F.count_if(inside(label))).alias("recall"),
    )


def class_metrics(df: DataFrame, label: str, pred: str, positive=1) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class in one aggregate."""
    y, p = F.col(label) == positive, F.col(pred) == positive
    counts = df.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def f_beta(df: DataFrame, label: str, pred: str, beta: float, positive=1) -> DataFrame:
    y, p = F.col(label) == positive, F.col(pred) == positive
    b = beta * beta
    hit = F.count_if(y & p)
    score = F.try_divide((1 + b) * hit, (1 + b) * hit + b * F.count_if(y & ~p) + F.count_if(~y & p))
    return df.agg(F.coalesce(score, F.lit(0.0)).alias("f_beta"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, mean absolute error and R2."""
    a, e = F.col(actual), F.col(predicted) - F.col(actual)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / (F.var_pop(a) * F.count(a))).alias("r2"),
    )


def residual_histogram(df: DataFrame, actual: str, predicted: str, bins: int = 10) -> DataFrame:
    return histogram(df.withColumn("residual", F.col(actual) - F.col(predicted)), "residual", bins)


def rmse_by_horizon(df: DataFrame, actual: str = "actual", predicted: str = "predicted", horizon: str = "horizon") -> DataFrame:
    """RMSE per step, plus the overall one under horizon 0."""
    sq = (F.col(actual) - F.col(predicted)) * (F.col(actual) - F.col(predicted))
    sums = df.groupBy(F.col(horizon).cast("int").alias("horizon")).agg(F.sum(sq).alias("sq"), F.count(sq).alias("n"))
    both = sums.unionByName(sums.agg(F.lit(0).alias("horizon"), F.sum("sq").alias("sq"), F.sum("n").alias("n")))
    return both.select("horizon", F.sqrt(F.col("sq") / F.col("n")).alias("rmse"))


def error_coverage(df: DataFrame, is_error: Column, cols: Sequence[str]) -> DataFrame:
    """Distinct values of each column in all rows and in the error rows."""
    flagged = df.select(*cols, is_error.alias("__e"))
    longs = flagged.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("p"),
        "__e",
    ).select("p.column", "p.v", "__e")
    per_value = longs.groupBy("column", "v").agg(F.max("__e").alias("e"))
    return per_value.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if("e").alias("n_error")
    )


def headway_to_bunching(df: DataFrame, pred: str = "pred", threshold: str | float = "threshold_min") -> DataFrame:
    """Turn a predicted headway into a label: bunched at or below the threshold."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    return df.withColumn("pred_bunched", F.col(pred) <= limit)


def score_to_label(df: DataFrame, pred: str = "pred", cut: float = 0.5) -> DataFrame:
    return df.withColumn("pred_label", (F.col(pred) >= cut).cast("int"))


def majority_vote(df: DataFrame, cols: Sequence[str], name: str = "vote") -> DataFrame:
    """Most frequent of the given columns; among equals the one that comes first."""
    scored = [
        F.struct(
            (-reduce(lambda a, b: a + b, [(F.col(c) == F.col(o)).cast("int") for o in cols])).alias("n"),
            F.lit(i).alias("i"),
            F.col(c).alias("v"),
        )
        for i, c in enumerate(cols)
    ]
    return df.withColumn(name, F.least(*scored)["v"])


def error_weights(df: DataFrame, label: str, pred: str, right: float = 0.1, missed: float = 0.5, false_alarm: float = 0.4) -> DataFrame:
    """Row weight for the next learner by the kind of error of the last one."""
    weight = F.when(F.col(label) == F.col(pred), right).when(F.col(label) == 1, missed).otherwise(false_alarm)
    return df.withColumn("weight", weight)


def mean_probability(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of class-probability arrays and the class with the largest mean (the first among equals)."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.col(c) for c in cols])
    mean = F.transform(total, lambda v: v / len(cols))
    return df.withColumn("probability", mean).withColumn(
        "prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("int")
    )
