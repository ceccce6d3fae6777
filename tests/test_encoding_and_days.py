"""Sparse one-hot vectors of any number of values, and day folders that a filter prunes."""

import datetime as dt

from pyspark.sql import functions as F

from busweave.operators.features import one_hot_vector
from busweave.sources import readers


def test_five_thousand_values(spark):
    rows = [(i, f"v{i % 5000:04d}", None if i % 4 == 0 else f"w{i % 3}", "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, a string, b string, one_hot string")
    out, slots = one_hot_vector(df, ["a", "b"])
    assert out.columns == ["id", "one_hot"]
    hot = {r.id: (list(r.one_hot.indices), list(r.one_hot.values), r.one_hot.size) for r in out.collect()}
    assert hot == {i: ([i % 5000] + ([5000 + i % 3] if i % 4 else []), [1.0] * (2 if i % 4 else 1), 5003) for i in range(6000)}
    named = sorted((r.slot, r.column, r.value) for r in slots.collect())
    assert named == [(i, "a", f"v{i:04d}") for i in range(5000)] + [(5000 + i, "b", f"w{i}") for i in range(3)]


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "id int, a string, b string")
    out, slots = one_hot_vector(df, ["a", "b"])
    assert sorted((r.id, r.one_hot.toArray().tolist()) for r in out.collect()) == [(1, [1.0]), (2, [0.0])]
    assert [tuple(r) for r in slots.collect()] == [(0, "b", "x")]
    none, slots = one_hot_vector(df, ["a"])
    assert [r.one_hot.size for r in none.collect()] == [0, 0] and slots.count() == 0
    assert one_hot_vector(df.limit(0), ["a", "b"])[0].count() == 0


def test_a_filter_on_the_day_chooses_folders(spark, tmp_path):
    for day in (1, 2, 3):
        folder = tmp_path / f"day=2024-01-0{day}"
        folder.mkdir()
        for part in (0, 1):
            (folder / f"part-{part}").write_text(f"route,bus\nr{day},{part}\n\n,\n")
    days = readers.read_day_folders(spark, str(tmp_path), "route string, bus int")
    assert days.count() == 6 and days.columns == ["route", "bus", "day"]
    some = days.where(F.col("day") >= dt.date(2024, 1, 2)).where("day < '2024-01-03'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert sorted((r.route, r.bus, str(r.day)) for r in some.collect()) == [("r2", 0, "2024-01-02"), ("r2", 1, "2024-01-02")]
    read = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("day=2024-01-02" in r.f for r in read)
