"""Ordered analytics (lead, lag, positions, running values) that survive hot keys.

A plain window sends every row of one key to one task. Here each key is cut into slices by a
function of the ordering column (an hour, a day, a block of sequence numbers). A window runs inside
``(key, slice)``; one summary row per slice then carries values across slice borders, so the only
window over a whole key sees slices, not rows. Window, summary and join go by the same columns, in
which null keys are filled and marked, so that the wide side is shuffled once and null is a key like
any other.

``slice_by`` must not decrease when the first ordering column grows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "__slice"
_FIRST_SLICE = -(2**63)


@dataclass(frozen=True)
class Carry:
    """How a value is computed in a slice, summed up per slice, carried and merged."""

    local: Callable
    summary: Callable
    carried: Callable
    merge: Callable


def _tagged(order: Sequence[str], value: Column) -> Column:
    return F.struct(*[F.col(c) for c in order], value.alias("__v"))


def following(*cols: str) -> Carry:
    """Struct of ``cols`` of the next row of the key, null on its last row."""
    row = F.struct(*cols)
    return Carry(
        local=lambda asc, desc: F.lead(row).over(asc),
        summary=lambda order: F.min(_tagged(order, row)),
        carried=lambda slices, s: F.lead(s).over(slices)["__v"],
        merge=lambda here, there: F.coalesce(here, there),
    )


def preceding(*cols: str) -> Carry:
    """Struct of ``cols`` of the previous row of the key, null on its first row."""
    row = F.struct(*cols)
    return Carry(
        local=lambda asc, desc: F.lag(row).over(asc),
        summary=lambda order: F.max(_tagged(order, row)),
        carried=lambda slices, s: F.lag(s).over(slices)["__v"],
        merge=lambda here, there: F.coalesce(here, there),
    )


def _before(slices):
    return slices.rowsBetween(Window.unboundedPreceding, -1)


def position() -> Carry:
    """Row number in the key, from 1."""
    return Carry(
        local=lambda asc, desc: F.row_number().over(asc).cast("long"),
        summary=lambda order: F.count(F.lit(1)),
        carried=lambda slices, s: F.sum(s).over(_before(slices)),
        merge=lambda here, there: here + F.coalesce(there, F.lit(0)),
    )


def running_sum(value: Column) -> Carry:
    """Sum of ``value`` up to and including the row."""
    return Carry(
        local=lambda asc, desc: F.sum(value).over(asc.rowsBetween(Window.unboundedPreceding, 0)),
        summary=lambda order: F.sum(value),
        carried=lambda slices, s: F.sum(s).over(_before(slices)),
        merge=lambda here, there: F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)),
    )


def last_seen(value: Column, inclusive: bool = True) -> Carry:
    """Latest non-null ``value`` at or before the row (strictly before if not ``inclusive``)."""
    end = 0 if inclusive else -1
    return Carry(
        local=lambda asc, desc: F.last(value, ignorenulls=True).over(
            asc.rowsBetween(Window.unboundedPreceding, end)
        ),
        summary=lambda order: F.max(F.when(value.isNotNull(), _tagged(order, value))),
        carried=lambda slices, s: F.last(s, ignorenulls=True).over(_before(slices))["__v"],
        merge=lambda here, there: F.coalesce(here, there),
    )


def next_seen(value: Column, inclusive: bool = True) -> Carry:
    """Earliest non-null ``value`` at or after the row; descending windows keep it linear."""
    end = 0 if inclusive else -1
    return Carry(
        local=lambda asc, desc: F.last(value, ignorenulls=True).over(
            desc.rowsBetween(Window.unboundedPreceding, end)
        ),
        summary=lambda order: F.min(F.when(value.isNotNull(), _tagged(order, value))),
        carried=lambda slices, s: F.first(s, ignorenulls=True).over(
            slices.rowsBetween(1, Window.unboundedFollowing)
        )["__v"],
        merge=lambda here, there: F.coalesce(here, there),
    )


def _filled(key: Column, kind: T.DataType) -> Column:
    """``key`` with a value of its type for null; a struct around it where no such value is at hand."""
    if isinstance(kind, T.StringType):
        return F.coalesce(key, F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(key, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(key, F.lit(0).cast(kind))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(key, F.lit("1970-01-01").cast(kind))
    return F.struct(key)


def over_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, **values: Carry
) -> DataFrame:
    """Add one column per entry of ``values``, ordered by ``order`` (a full tie-break) in each key."""
    keys, order = list(keys), list(order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)], F.lit(0))
    parts = [f"__k_{k}" for k in keys] + (["__k_nulls"] if keys else [])
    sliced = df.withColumns(
        {
            SLICE: F.coalesce(slice_by.cast("long"), F.lit(_FIRST_SLICE)),
            **{f"__k_{k}": _filled(F.col(k), kinds[k]) for k in keys},
            **({"__k_nulls": nulls} if keys else {}),
        }
    )
    asc = Window.partitionBy(*parts, SLICE).orderBy(*[F.col(c).asc() for c in order])
    desc = Window.partitionBy(*parts, SLICE).orderBy(*[F.col(c).desc() for c in order])
    local = sliced.withColumns({f"__in_{n}": v.local(asc, desc) for n, v in values.items()})

    summary = sliced.groupBy(*parts, SLICE).agg(*[v.summary(order).alias(f"__s_{n}") for n, v in values.items()])
    slices = Window.partitionBy(*parts).orderBy(SLICE)
    carried = summary.select(
        *parts, SLICE, *[v.carried(slices, F.col(f"__s_{n}")).alias(f"__out_{n}") for n, v in values.items()]
    )
    joined = local.join(carried, [*parts, SLICE], "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in values],
        *[v.merge(F.col(f"__in_{n}"), F.col(f"__out_{n}")).alias(n) for n, v in values.items()],
    )


def look_around(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    before: int,
    after: int,
    block: int = 8192,
    **values: Callable,
) -> DataFrame:
    """Windows that reach a fixed number of rows back or ahead.

    Rows get positions, positions make blocks, and the few rows at block borders are copied into
    the neighbouring block, so each ``values[name](window)`` runs on blocks of bounded size.
    """
    placed = over_slices(df, keys, order, slice_by, __pos=position())
    zero = F.col("__pos") - 1
    home = F.floor(zero / block)
    blocks = F.array_distinct(
        F.array(home, F.floor((zero - after) / block), F.floor((zero + before) / block))
    )
    spread = placed.withColumn("__home", home).withColumn("__block", F.explode(blocks))
    window = Window.partitionBy(*keys, "__block").orderBy("__pos")
    return (
        spread.withColumns({n: make(window) for n, make in values.items()})
        .where("__block = __home")
        .drop("__block", "__home", "__pos")
    )


def hours(ts: str, size_s: int = 3600) -> Column:
    """Slice of ``size_s`` seconds."""
    return F.floor(F.col(ts).cast("long") / size_s)


def blocks_of(seq: str, size: int) -> Column:
    """Slice of ``size`` consecutive values of an integer column."""
    return F.floor(F.col(seq) / size)
