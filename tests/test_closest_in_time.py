"""Closest report in time: equal to brute force, and no row meets the reports of its hour one by one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busweave.operators.best import closest_in_time
from busweave.operators.enrich import match_alerts


def _frames(spark, n, m, span_s, seed):
    rng = np.random.default_rng(seed)
    start = 1_700_000_000
    rows = pd.DataFrame({"id": np.arange(n), "k": rng.integers(0, 2, n), "at": start + rng.integers(0, span_s * 10, n) / 10})
    options = pd.DataFrame({"oid": rng.integers(0, max(1, m // 2), m), "k": rng.integers(0, 2, m), "oat": start + rng.integers(0, span_s * 10, m) / 10})
    a = spark.createDataFrame(rows).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    b = spark.createDataFrame(options).withColumn("ots", F.timestamp_micros((F.col("oat") * 1e6).cast("long")))
    return rows, options, a, b


@pytest.mark.parametrize("seed,m,before,after", [(1, 40, 60, 10), (2, 400, 2, 1), (3, 5, 0, 10), (4, 25, 3, 4)])
def test_closest_in_time_is_brute_force(spark, seed, m, before, after):
    rows, options, a, b = _frames(spark, 150, m, 1800, seed)
    valid = lambda g: ((g <= 0) & (F.abs(g) < before)) | ((g > 0) & (g < after))
    found = closest_in_time(a, b, ["k"], ["id"], "ts", "ots", ["oid"], ["oid"], valid, skip=0 if before > 0 else 60)
    got = {r["id"]: r["oid"] for r in found.collect()}
    want = {}
    for r in rows.itertuples():
        best = None
        for o in options[options.k == r.k].itertuples():
            gap = int((np.floor(o.oat) - np.floor(r.at)) / 60)
            if (gap <= 0 and -gap < before) or 0 < gap < after:
                score = (abs(gap), o.oat, o.oid)
                best = score if best is None or score < best else best
        want[r.id] = None if best is None else best[2]
    assert got == want


def test_dense_hour_is_not_paired(spark, tmp_path):
    """40,000 rows and 40,000 reports of one place and hour: 1.6 billion pairs, of which none is formed."""
    n = 40_000
    rows = spark.range(n).select(
        F.col("id"), F.lit(1).alias("cell"), F.lit("S").alias("street"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") % 3600).alias("ts"),
    )
    alerts = rows.withColumnRenamed("id", "alert_id")
    found = match_alerts(rows, alerts, ["id"], ["alert_id"])
    path = str(tmp_path / "out")
    found.write.parquet(path)
    out = spark.read.parquet(path)
    assert out.count() == n and out.where("alert_id IS NULL").count() == 0
    # The minute before and the minute after count as no minutes apart: the earliest of them is 59 seconds older.
    late = out.where("id = 3000").first()
    assert late["alert_id"] == 2941


def test_windows_and_their_shuffles_see_seconds_not_values(spark):
    """What an option says is joined once a second has won; ids of several rows keep the closest of all, null ids too."""
    rows = spark.sql("SELECT * FROM VALUES (1, 'k', timestamp'2024-01-01 08:00:00'), (1, 'k', timestamp'2024-01-01 08:07:30'), (null, 'k', timestamp'2024-01-01 07:50:59'), (2, 'j', timestamp'2024-01-01 08:00:00') AS t(id, k, ts)")
    options = spark.sql("SELECT k, ots, oid, repeat(oid, 50) AS said FROM VALUES ('k', timestamp'2024-01-01 07:50:10', 'a'), ('k', timestamp'2024-01-01 07:50:10.5', 'b'), ('k', timestamp'2024-01-01 08:08:00', 'c') AS t(k, ots, oid)")
    found = closest_in_time(rows, options, ["k"], ["id"], "ts", "ots", ["oid"], ["oid", "said"], keep=[])
    assert found.columns == ["id", "oid", "said"]
    assert sorted((str(r.id), r.oid, r.said) for r in found.collect()) == [("1", "c", "c" * 50), ("2", None, None), ("None", "a", "a" * 50)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and not any("said" in line or "__v" in line for line in windows)
