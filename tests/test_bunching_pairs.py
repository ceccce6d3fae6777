"""Pairs of passing vehicles: equal to brute force, also around the date line and the poles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busweave.operators.bunching import bunching_pairs

R = 6371000.0


def _metres(a, b):
    la, lb = np.radians(a.lat), np.radians(b.lat)
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b.lon - a.lon) / 2) ** 2
    return round(2 * R * np.arctan2(np.sqrt(h), np.sqrt(1 - h)), 3)


@pytest.mark.parametrize("lat,lon,spread,gap_s", [(-25.0, -49.0, 0.01, 7.5), (-25.0, -49.0, 0.01, 300), (70.0, 179.999, 0.02, 60), (89.995, 10.0, 0.01, 60)])
def test_bunching_pairs_are_brute_force(spark, lat, lon, spread, gap_s):
    rng = np.random.default_rng(int(lat) + 100)
    n = 160
    rows = pd.DataFrame({"id": np.arange(n), "bus": rng.integers(0, 6, n), "date": 1, "at": 1_700_000_400 + rng.integers(0, 900, n) / 2.0})
    rows["lat"] = np.minimum(lat + rng.uniform(-spread, spread, n), 90.0)
    rows["lon"] = lon + rng.uniform(-spread, spread, n) * (2000 if lat > 80 else 1)
    rows["lon"] = (rows["lon"] + 180) % 360 - 180
    df = spark.createDataFrame(rows).withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = {(r["id_a"], r["id_b"]): r["distance_m"] for r in bunching_pairs(df, keys=["date"], distance_m=400, gap_s=gap_s).collect()}
    want, all_rows = {}, list(rows.itertuples())
    for a in all_rows:
        for bus in range(6):
            options = [b for b in all_rows if b.bus == bus and bus != a.bus and b.at // 600 == a.at // 600]
            if options:
                b = min(options, key=lambda b: (abs(a.at - b.at), b.id))
                if abs(a.at - b.at) < gap_s and _metres(a, b) < 400:
                    want[a.id, b.id] = _metres(a, b)
    assert want and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 0.002 for k in want)


def test_only_near_places_are_paired(spark, tmp_path):
    """6,000 buses at one moment, 1 km apart: 36 million pairs in time, none in place."""
    df = spark.range(6000).select(
        "id", F.col("id").alias("bus"), F.lit(1).alias("date"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"),
        ((F.col("id") % 80) / 100.0).alias("lat"), (F.expr("id div 80") / 100.0).alias("lon"),
    )
    pairs = bunching_pairs(df, keys=["date"])
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan
