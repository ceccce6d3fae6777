"""What the nearest join broadcasts is bounded by rows, not by how well a file compresses."""

from pyspark.sql import functions as F

from busweave.operators import nearest
from busweave.operators.nearest import nearest_point, sized


def test_many_rows_are_not_broadcast(spark, tmp_path):
    spark.range(60_000).select("id", F.lit(0.5).alias("x")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    other = spark.range(10).withColumnRenamed("id", "id")
    assert "BroadcastHashJoin" in plan(table.join(sized(other, 10), "id"))
    assert "SortMergeJoin" in plan(table.join(sized(table, 60_000), "id"))


def test_shuffled_sides_give_the_same_places(spark, monkeypatch):
    stops = spark.range(400).select("id", (F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 101 / 50.0).alias("lat"), ((F.col("id") * 53) % 97 / 50.0).alias("lon"))
    places = stops.select(F.col("id").alias("pid"), "k", (F.col("lat") * 0.9).alias("lat"), (F.col("lon") * 1.1).alias("lon"))

    def answer():
        out = nearest_point(stops, places, ["id"], ["k"], ["pid"], ["pid"])
        return {r["id"]: (r["pid"], r["distance_m"]) for r in out.collect()}

    broadcast = answer()
    monkeypatch.setattr(nearest, "SMALL_ROWS", 0)
    assert answer() == broadcast
