"""Text clean-up and small look-ups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

# Transport modes in index order.
MODES = ("walk", "bike", "bus", "driving", "train")
MODE_GROUPS = {
    "walk": "walk",
    "bike": "bike",
    "bus": "bus",
    "car": "driving",
    "taxi": "driving",
    "subway": "train",
    "railway": "train",
    "train": "train",
}


def parse_point(text: Column) -> Column:
    """``{"x": .., "y": ..}`` to a struct."""
    return F.from_json(text, POINT)


def parse_line(text: Column) -> Column:
    """Array of points."""
    return F.from_json(text, T.ArrayType(POINT))


def abbreviate_street(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("Avenida"), F.lit("Av.")), F.lit("Rua"), F.lit("R."))


def unquote(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit('"'), F.lit("")))


def to_number(text: Column, kind: str = "double") -> Column:
    return unquote(text).try_cast(kind)


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def mode_index(name: Column) -> Column:
    """Ground transport mode to its index; other modes give null."""
    index = {mode: MODES.index(group) for mode, group in MODE_GROUPS.items()}
    pairs = [F.lit(v) for item in index.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), name)


def dash_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    names = cols or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.nullif(F.col(c), F.lit("-")), F.lit("nan")) for c in names})


def null_to_dash(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    names = cols or df.columns
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names})
