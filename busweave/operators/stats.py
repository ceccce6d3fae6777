"""Correlation and hypothesis tests as distributed aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busweave.operators.ordered import over_slices, position, running_sum
from busweave.operators.quantiles import RANGE, mid_ranks, ranged
from busweave.session import checkpointed


def _long(one_row: DataFrame, pairs: Sequence[tuple[str, str]], names: Sequence[str]) -> DataFrame:
    """One-row frame of pair values to ``x, y, corr`` in both directions."""
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(n).alias("corr"))
        for (x, y), n in zip(pairs, names)
        for a, b in ((x, y), (y, x))
    ]
    return one_row.select(F.explode(F.array(*cells)).alias("c")).select("c.x", "c.y", "c.corr")


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All off-diagonal Pearson correlations in one aggregate pass."""
    pairs = list(combinations(cols, 2))
    names = [f"__c{i}" for i in range(len(pairs))]
    one = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(n) for (x, y), n in zip(pairs, names)])
    return _long(one, pairs, names)


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of mid-ranks over rows complete in ``cols``.

    Equal rows are counted first. Each column has a rank table with one row per distinct value.
    """
    cols = list(cols)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    ranks = mid_ranks(rows, cols)
    for c in cols:
        of_column = ranks.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("mid_rank").alias(f"__r_{c}"))
        counted = counted.join(of_column, c)
    total = rows.count()
    centred = {c: F.col(f"__r_{c}") - (total + 1) / 2 for c in cols}
    pairs = list(combinations(cols, 2))
    names = [f"__c{i}" for i in range(len(pairs))]
    product = lambda x, y: F.sum(F.col("__n") * centred[x] * centred[y])
    one = counted.agg(
        *[F.try_divide(product(x, y), F.sqrt(product(x, x) * product(y, y))).alias(n) for (x, y), n in zip(pairs, names)]
    )
    return _long(one, pairs, names)


def _ties(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of rows that are equal in ``keys``."""
    n = F.col("__n").cast("double")
    return df.groupBy(*keys).agg(F.sum("__n").alias("__n")).agg(F.sum(n * (n - 1) / 2).alias("t"))


def kendall_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b of two columns: one row ``x, y, corr``.

    No pairs of rows are formed. Discordant pairs are counted bit by bit of the dense rank of ``y``:
    two rows whose ranks share all higher bits differ in order exactly at one bit, and a running
    count in the order of ``x`` tells how many rows with that bit set lie before. Work grows with the
    number of distinct (x, y) times the bits of the rank.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    counted = checkpointed(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("__n")), "pair-counts")
    distinct = ranged(counted.select("y").distinct(), ["y"], "pair-values")
    ranked = over_slices(distinct, [], ["y"], F.col(RANGE), __r=position()).drop(RANGE)
    bits = max(1, int(distinct.count()).bit_length())
    placed = counted.join(ranked, "y")
    leveled = placed.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    above = F.expr("shiftright(__r, __b + 1)")
    is_set = F.expr("shiftright(__r, __b) & 1") == 1
    groups = leveled.groupBy("__b", above.alias("__up"), "x").agg(
        F.sum(F.when(is_set, F.col("__n")).otherwise(0)).alias("__ones"),
        F.sum(F.when(~is_set, F.col("__n")).otherwise(0)).alias("__zeros"),
    )
    groups = ranged(groups, ["__b", "__up", "x"], "pair-bits")
    run = over_slices(groups, ["__b", "__up"], ["x"], F.col(RANGE), __upto=running_sum(F.col("__ones")))
    before = (F.col("__upto") - F.col("__ones")).cast("double")
    discordant = run.agg(F.sum(before * F.col("__zeros")).alias("q"))
    total = counted.agg(F.sum("__n").cast("double").alias("n"))
    tx, ty, txy = _ties(counted, ["x"]), _ties(counted, ["y"]), _ties(counted, ["x", "y"])
    parts_ = [
        total.select(F.struct(F.lit("n").alias("k"), F.col("n").alias("v")).alias("s")),
        discordant.select(F.struct(F.lit("q").alias("k"), F.coalesce("q", F.lit(0.0)).alias("v")).alias("s")),
        tx.select(F.struct(F.lit("tx").alias("k"), F.col("t").alias("v")).alias("s")),
        ty.select(F.struct(F.lit("ty").alias("k"), F.col("t").alias("v")).alias("s")),
        txy.select(F.struct(F.lit("txy").alias("k"), F.col("t").alias("v")).alias("s")),
    ]
    union = parts_[0]
    for p in parts_[1:]:
        union = union.unionByName(p)
    value = lambda k: F.max(F.when(F.col("s.k") == k, F.col("s.v")))
    one = union.agg(*[value(k).alias(k) for k in ("n", "q", "tx", "ty", "txy")])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    excess = (pairs - F.col("tx") - F.col("ty") + F.col("txy")) - 2 * F.col("q")
    tau = F.try_divide(excess, F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty"))))
    return one.select(F.lit(x).alias("x"), F.lit(y).alias("y"), tau.alias("corr"))


def kendall(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Tau-b of every pair of columns, in both directions."""
    out = None
    for x, y in combinations(cols, 2):
        pair = kendall_pair(df, x, y)
        both = pair.unionByName(pair.select(F.col("y").alias("x"), F.col("x").alias("y"), "corr"))
        out = both if out is None else out.unionByName(both)
    return out


def median_abs(corr: DataFrame) -> DataFrame:
    """Median of the absolute correlations per column (a matrix is small)."""
    return corr.groupBy("x").agg(F.percentile(F.abs("corr"), 0.5).alias("median_abs"))


def pairs_over(corr: DataFrame, threshold: float, below: bool = False) -> DataFrame:
    """Pairs whose absolute correlation lies above (or below) a threshold, each pair once."""
    size = F.abs("corr")
    return corr.where((F.col("x") < F.col("y")) & ((size < threshold) if below else (size > threshold)))


def correlated_with(corr: DataFrame, targets: Sequence[str], at_least: float) -> DataFrame:
    """Rows of the matrix for the target columns, weak ones dropped, strongest first."""
    return corr.where(F.col("x").isin(list(targets)) & (F.abs("corr") >= at_least)).orderBy(F.abs("corr").desc(), "x", "y")


def chi2_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-square of each non-negative feature's class sums against the class shares."""
    by_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in features])
    longs = by_class.select(
        F.col("__n"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("seen")) for c in features])).alias("f")
    ).select("__n", "f.feature", "f.seen")
    totals = longs.groupBy("feature").agg(F.sum("__n").alias("__all"), F.sum("seen").alias("__total"))
    expected = F.col("__n") / F.col("__all") * F.col("__total")
    part = F.try_divide((F.col("seen") - expected) * (F.col("seen") - expected), expected)
    return longs.join(totals, "feature").groupBy("feature").agg(F.sum(part).alias("score"))


def k_best(df: DataFrame, features: Sequence[str], label: str, k: int) -> DataFrame:
    """The k features with the largest chi-square score."""
    return chi2_scores(df, features, label).orderBy(F.col("score").desc(), "feature").limit(k)


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """U of the rows whose ``group`` flag is set against the rest, with the tie-corrected z and the
    two-sided p of the normal approximation."""
    rows = df.select(F.col(group).cast("int").alias("g"), F.col(value).cast("double").alias("v")).dropna()
    ranks = mid_ranks(rows, ["v"]).select(F.col("value").alias("v"), "n", "mid_rank")
    mine = rows.groupBy("v").agg(F.sum("g").alias("n1"))
    n = F.col("n").cast("double")
    one = ranks.join(mine, "v").agg(
        F.sum(F.col("n1") * F.col("mid_rank")).alias("r1"),
        F.sum("n1").cast("double").alias("n1"),
        F.sum(n).alias("n"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n1, n2, total = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    scored = one.select(u1.alias("u1"), F.least(u1, n1 * n2 - u1).alias("u"), F.try_divide(u1 - n1 * n2 / 2, spread).alias("z"))
    return scored.withColumn("p_value", two_sided_p(F.col("z")))


def friedman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Friedman's chi-square over paired columns, ties corrected, with its p value."""
    k = len(cols)
    equal = {c: sum(((F.col(o) == F.col(c)).cast("int") for o in cols), F.lit(0)) for c in cols}
    rank = {
        c: sum(((F.col(o) < F.col(c)).cast("int") for o in cols), F.lit(0)) + (equal[c] + 1) / 2 for c in cols
    }
    ties = sum(((equal[c] * equal[c] - 1) for c in cols), F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(ties).cast("double").alias("ties"),
        *[F.sum(rank[c].cast("double")).alias(f"r{i}") for i, c in enumerate(cols)],
    )
    squares = sum((F.col(f"r{i}") * F.col(f"r{i}") for i in range(k)), F.lit(0.0))
    raw = 12.0 / (k * (k + 1)) * squares / F.col("n") - 3 * F.col("n") * (k + 1)
    correction = 1 - F.col("ties") / (F.col("n") * (k * (k * k - 1)))
    scored = one.select(F.try_divide(raw, correction).alias("chi2"), F.lit(k - 1).alias("dof"))
    return scored.withColumn("p_value", chi2_tail(F.col("chi2"), F.col("dof")))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def _chi2_tail(x: float, dof: int) -> float:
    half = x / 2
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.sqrt(half) * 2 / math.sqrt(math.pi)
    for i in range((dof - 1) // 2):
        total += math.exp(-half) * term
        term *= half / (i + 1.5)
    return total


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    return pd.Series([_chi2_tail(a, int(b)) for a, b in zip(x, dof)], dtype="float64")


def share_interval(p: Column, alpha: float, n: Column, z: float | None = None) -> tuple[Column, Column]:
    """Interval of a proportion. The factor is ``1 - alpha / 2`` itself unless a normal quantile ``z`` is given."""
    half = F.lit(1 - alpha / 2 if z is None else z) * F.sqrt(p * (1 - p) / n)
    return p - half, p + half

