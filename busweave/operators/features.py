"""Feature preparation: fills, encodings, scaling, look-ahead labels, subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.operators.ordered import look_around, over_slices, position
from busweave.operators.quantiles import RANGE, exact_quantiles, ranged
from busweave.session import checkpointed


def fill_missing(df: DataFrame, fills: dict[str, str | float | int]) -> DataFrame:
    """Fill each column from another column (given by name) or a constant number."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.col(v) if isinstance(v, str) else F.lit(v)) for c, v in fills.items()}
    )


def residual_of_totals(total: str, parts: Sequence[str]) -> Column:
    """What a total (in thousands per hour) leaves after its per-minute parts."""
    rest = F.col(total) * 1000 / 60
    inner = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return rest - inner


def booleans_to_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def impute_group_median(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Fill nulls of numeric columns with the exact median of the row's group."""
    by, cols = list(by), list(cols)
    medians = (
        exact_quantiles(df, cols, {"median": 0.5}, by)
        .groupBy(*by)
        .pivot("feature", cols)
        .agg(F.first("median"))
        .select(*by, *[F.col(c).alias(f"__m_{c}") for c in cols])
    )
    joined = df.join(medians, by, "left")
    return joined.withColumns({c: F.coalesce(c, f"__m_{c}") for c in cols}).select(*df.columns)


def one_hot(df: DataFrame, values: dict[str, Sequence[str]]) -> DataFrame:
    """Indicator columns ``<column>_<value>`` for known values; the text columns drop out."""
    new = {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c, vs in values.items() for v in vs}
    return df.withColumns(new).drop(*values)


def known_values(df: DataFrame, cols: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Distinct texts of each column. Raises when a column has more than ``limit`` of them."""
    out = {}
    for c in cols:
        found = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"column {c} has more than {limit} distinct values")
        out[c] = sorted(found)
    return out


def _codes(df: DataFrame, c: str) -> DataFrame:
    """``__v_<c>, __code_<c>``: rank of each distinct value of the column among all of them, from 0."""
    distinct = ranged(df.select(c).where(F.col(c).isNotNull()).distinct(), [c], "label-values")
    return over_slices(distinct, [], [c], F.col(RANGE), __code=position()).select(
        F.col(c).alias(f"__v_{c}"), (F.col("__code") - 1).alias(f"__code_{c}")
    )


def label_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by the rank of its value among the sorted distinct values.

    The code table has one row per distinct value and is joined back; Spark broadcasts it only when
    its measured size is small.
    """
    out = df
    for c in cols:
        out = out.join(_codes(df, c), F.col(c) == F.col(f"__v_{c}"), "left").drop(f"__v_{c}")
        out = out.withColumn(c, F.col(f"__code_{c}")).drop(f"__code_{c}")
    return out.select(*df.columns)


def one_hot_vector(df: DataFrame, cols: Sequence[str], out: str = "one_hot") -> tuple[DataFrame, DataFrame]:
    """``df`` with a sparse vector in place of ``cols``, and its slots ``(slot, column, value)``.

    Each column has a slot per distinct value, in order; columns follow each other. Null sets no slot. There may be
    any number of values: they stay in tables, a row's vector holds a number per column, and only the number of
    values of each column reaches the driver.
    """
    rows, slots, size, filled = df, None, 0, []
    for c in cols:
        codes = checkpointed(_codes(df, c), "codes")
        n = codes.count()
        listed = codes.select((F.col(f"__code_{c}") + size).alias("slot"), F.lit(c).alias("column"), F.col(f"__v_{c}").cast("string").alias("value"))
        slots = listed if slots is None else slots.unionByName(listed)
        # Null takes the code behind the last one, which the encoder leaves out.
        nominal = {"ml_attr": {"type": "nominal", "name": f"__i_{c}", "num_vals": n + 1}}
        code = F.coalesce(F.col(f"__code_{c}"), F.lit(n)).cast("double").alias(f"__i_{c}", metadata=nominal)
        rows = rows.join(codes, F.col(c) == F.col(f"__v_{c}"), "left").select(*rows.columns, code)
        size += n
        filled += [c] if n else []
    kept = [c for c in df.columns if c not in {*cols, out}]
    if not filled:  # columns of nulls only have no slot
        return rows.select(*kept, array_to_vector(F.array().cast("array<double>")).alias(out)), slots
    encoder = OneHotEncoder(inputCols=[f"__i_{c}" for c in filled], outputCols=[f"__h_{c}" for c in filled], dropLast=True)
    whole = VectorAssembler(inputCols=[f"__h_{c}" for c in filled], outputCol="__hot").transform(encoder.fit(rows).transform(rows))
    return whole.select(*kept, F.col("__hot").alias(out)), slots


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0. The bounds, one row, are constants of the second pass."""
    bounds = df.agg(
        *[F.min(c).alias(f"__lo_{c}") for c in cols], *[F.max(c).alias(f"__hi_{c}") for c in cols]
    ).first()
    return df.withColumns(
        {
            c: F.lit(0.0)
            if bounds[f"__hi_{c}"] is None or bounds[f"__hi_{c}"] == bounds[f"__lo_{c}"]
            else (F.col(c) - bounds[f"__lo_{c}"]) / (bounds[f"__hi_{c}"] - bounds[f"__lo_{c}"])
            for c in cols
        }
    )


def robust_scale(
    df: DataFrame, cols: Sequence[str], low_pct: float = 0.05, high_pct: float = 0.95, edge: float = 1.0
) -> DataFrame:
    """Centre and scale per column: the median, and twice the larger distance of two percentiles to it.

    ``low_pct`` and ``high_pct`` are percents, as the source passes them.
    """
    q = exact_quantiles(df, cols, {"mid": 0.5, "low": low_pct / 100, "high": high_pct / 100})
    spread = F.greatest(F.abs(F.col("low") - F.col("mid")), F.abs(F.col("high") - F.col("mid"))) * (2.0 / edge)
    return q.select("feature", F.col("mid").alias("centre"), F.when(spread <= 2.220446049250313e-16, 1.0).otherwise(spread).alias("scale"))


def row_hash(key: str) -> Column:
    """32-bit number from the MD5 of the key, the same in any engine."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")


def split(df: DataFrame, key: str, train_share: float) -> DataFrame:
    """Mark rows for training by a hash of their key, so the split never changes between runs."""
    return df.withColumn("is_train", row_hash(key) % 100 < int(round(train_share * 100)))


def undersample(df: DataFrame, label: str, key: str) -> DataFrame:
    """Keep as many rows of every class as the smallest class has, picked by key hash."""
    counts = df.groupBy(label).count()
    smallest = counts.agg(F.min("count")).first()[0] or 0
    hashed = df.withColumn("__h", row_hash(key))
    placed = over_slices(hashed, [label], ["__h", key], F.floor(F.col("__h") / 2**24), __pos=position())
    return placed.where(F.col("__pos") <= smallest).drop("__pos", "__h")


def day_subset(df: DataFrame, days: Sequence, ts: str = "ts") -> DataFrame:
    return df.where(F.to_date(ts).isin([F.lit(d).cast("date") for d in days]))


def day_shares(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows and share of all rows per day."""
    counts = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    total = df.count()
    return counts.withColumn("share", F.col("rows") / total)


def label_ahead(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], slice_by: Column, label: str, name: str = "ahead"
) -> DataFrame:
    """Label of the row ``n`` places later in the same key."""
    return look_around(df, keys, order, slice_by, 0, n, **{name: lambda w: F.lead(label, n).over(w)})


def labels_ahead(
    df: DataFrame,
    n_steps: int,
    pair: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    label: str,
    default: int = 0,
) -> DataFrame:
    """Labels 1 to ``n_steps`` rows ahead of the same bus pair, ``default`` past its end."""
    def step(k):
        return lambda w: F.coalesce(F.lead(label, k).over(w), F.lit(default))

    return look_around(df, pair, order, slice_by, 0, n_steps, **{f"step_{k}": step(k) for k in range(1, n_steps + 1)})


