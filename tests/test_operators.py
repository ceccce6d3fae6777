"""Operators against brute force on small fixtures, hot keys included."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busweave.operators import bunching, enrich, interpolate, matching, neighbours, ordered, quantiles, stats
from busweave.operators.headway import label_bunching, next_bus_headway
from busweave.operators import nearest
from busweave.operators.nearest import nearest_point
from busweave.operators.shaping import top_values
from busweave.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, values with holes."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(9)}"
        rows.append((key, i, rng.randrange(5000), rng.choice([None, float(rng.randrange(50))])))
    pdf = pd.DataFrame(rows, columns=["key", "id", "at", "v"])
    return spark.createDataFrame(rows, "key string, id long, at long, v double"), pdf.sort_values(["key", "at", "id"])


@pytest.mark.parametrize("size", [1, 37, 1000, 10**6])
def test_over_slices_equals_plain_windows(skewed, size):
    df, pdf = skewed
    out = ordered.over_slices(
        df, ["key"], ["at", "id"], F.floor(F.col("at") / size),
        nxt=ordered.following("id"), prv=ordered.preceding("id"), pos=ordered.position(),
        run=ordered.running_sum(F.coalesce("v", F.lit(0.0))), seen=ordered.last_seen(F.col("v")),
        before=ordered.last_seen(F.col("v"), inclusive=False), ahead=ordered.next_seen(F.col("v")),
    )
    got = out.select("key", "id", "at", "v", F.col("nxt.id").alias("nxt"), F.col("prv.id").alias("prv"), "pos", "run", "seen", "before", "ahead")
    got = got.toPandas().sort_values(["key", "at", "id"]).reset_index(drop=True)
    g = pdf.groupby("key")
    want = pdf.assign(
        nxt=g["id"].shift(-1), prv=g["id"].shift(1), pos=g.cumcount() + 1,
        run=pdf["v"].fillna(0).groupby(pdf["key"]).cumsum(), seen=g["v"].ffill(), ahead=g["v"].bfill(),
    ).reset_index(drop=True)
    want["before"] = want.groupby("key")["seen"].shift(1)
    for c in ("nxt", "prv", "pos", "run", "seen", "before", "ahead"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


@pytest.mark.parametrize("block", [3, 8, 4096])
def test_look_around(skewed, block):
    df, pdf = skewed
    out = ordered.look_around(
        df, ["key"], ["at", "id"], F.floor(F.col("at") / 100), 2, 3, block,
        back=lambda w: F.lag("id", 2).over(w), ahead=lambda w: F.lead("id", 3).over(w),
    ).toPandas().sort_values(["key", "at", "id"])
    g = pdf.groupby("key")
    assert len(out) == len(pdf)
    np.testing.assert_allclose(out["back"].astype(float), g["id"].shift(2).astype(float))
    np.testing.assert_allclose(out["ahead"].astype(float), g["id"].shift(-3).astype(float))


def test_exact_quantiles(skewed):
    df, pdf = skewed
    out = quantiles.exact_quantiles(df, ["v", "at"], {"q10": 0.1, "mid": 0.5}, ["key"]).toPandas().set_index(["key", "feature"])
    for key, part in pdf.groupby("key"):
        for c in ("v", "at"):
            assert out.loc[(key, c), "mid"] == pytest.approx(part[c].median())
            assert out.loc[(key, c), "q10"] == pytest.approx(np.nanpercentile(part[c], 10))


@pytest.mark.parametrize("keys, size, rows", [(["g"], None, 64), ([], None, 64), (["g"], 0.5, 3)])
def test_nearest_point(spark, monkeypatch, keys, size, rows):
    monkeypatch.setattr(nearest, "LIST_ROWS", rows)
    rng = random.Random(3)
    left = [(i, rng.randrange(3), rng.uniform(-26, -24), rng.uniform(-50, -48)) for i in range(150)] + [(999, 1, 10.0, 120.0)]
    right = [(j, rng.randrange(3), round(rng.uniform(-26, -24), 2), round(rng.uniform(-50, -48), 2)) for j in range(80)]
    right += [(j + 1000, g, a, b) for j, g, a, b in right[:20]]
    out = nearest_point(
        spark.createDataFrame(left, "id long, g int, lat double, lon double"),
        spark.createDataFrame(right, "pid long, g int, lat double, lon double"),
        ["id"], keys, ["pid"], ["pid"], size=size,
    ).toPandas().set_index("id")
    assert len(out) == len(left)
    for i, g, lat, lon in left:
        options = [(round(hav(lat, lon, a, b), 3), j) for j, h, a, b in right if not keys or h == g]
        assert (out.loc[i, "distance_m"], out.loc[i, "pid"]) == min(options)


def test_kendall_spearman_against_definition(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(40)), float(rng.randrange(15)) + rng.choice([0, 0.5])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double")
    n = len(rows)
    s = sum(np.sign(rows[i][0] - rows[j][0]) * np.sign(rows[i][1] - rows[j][1]) for i in range(n) for j in range(i))
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    ties = lambda c: (pdf.groupby(c).size() * (pdf.groupby(c).size() - 1) / 2).sum()
    want = s / math.sqrt((n * (n - 1) / 2 - ties("a")) * (n * (n - 1) / 2 - ties("b")))
    assert stats.kendall_pair(df, "a", "b").first()["corr"] == pytest.approx(want)
    ranks = pdf.rank()
    assert stats.spearman(df, ["a", "b"]).first()["corr"] == pytest.approx(ranks["a"].corr(ranks["b"]))


def test_tails(spark):
    # Well-known quantiles of the two distributions.
    row = spark.range(1).select(
        stats.two_sided_p(F.lit(1.959963985)).alias("z"), stats.chi2_tail(F.lit(3.841458821), F.lit(1)).alias("c1"),
        stats.chi2_tail(F.lit(5.991464547), F.lit(2)).alias("c2"), stats.chi2_tail(F.lit(7.814727903), F.lit(3)).alias("c3"),
        stats.chi2_tail(F.lit(11.07049769), F.lit(5)).alias("c5"),
    ).first()
    assert list(row) == pytest.approx([0.05] * 5, abs=1e-7)


def test_knn_exact_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    vectors = np.vstack([rng.normal(c, 0.3, (60, 3)) for c in (0, 4, 9)])
    rows = [(i, v.tolist(), int(i // 60)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = neighbours.knn_neighbours(df, df, "id", "v", 4, pivots=5, leave_self_out=True).toPandas()
    for i, part in got.groupby("test_id"):
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        want = sorted((d[j], j) for j in range(len(rows)) if j != i)[:4]
        assert part.sort_values("place")["train_id"].tolist() == [j for _, j in want]


def test_top_values_keeps_repeats(spark):
    df = spark.createDataFrame([("a", 5.0)] * 4 + [("a", 7.0), ("b", 1.0)], "k string, v double")
    got = {r["k"]: r["top"] for r in top_values(df, ["k"], "v", 3).collect()}
    assert got == {"a": [7.0, 5.0, 5.0], "b": [1.0]}


def test_headway_drops_same_vehicle_and_compat(spark):
    rows = [("r", "b1", 0), ("r", "b2", 4), ("r", "b2", 6), ("r", "b3", 20)]
    df = spark.createDataFrame([(r, b, T0 + dt.timedelta(minutes=m)) for r, b, m in rows], "route string, bus string, ts timestamp")
    out = label_bunching(next_bus_headway(df, ["route"])).select("bus", "sb.bus", "headway_min", "bunched").collect()
    assert {tuple(r) for r in out} == {("b1", "b2", 4, True), ("b2", "b3", 14, False)}
    assert [r["bus"] for r in next_bus_headway(df, ["route"], compat=True).collect()] == ["b1"]


def test_interpolated_time_lies_between_its_neighbours(spark):
    rows = [(1, 0.0, None), (2, 10.0, 1000), (3, 20.0, None), (4, 25.0, None), (5, 30.0, 3000), (6, 40.0, None), (7, 30.0, None)]
    df = spark.createDataFrame([("t", *r) for r in rows], "trip string, seq long, dist double, at_ms long")
    out = {r["seq"]: r["est_ms"] for r in interpolate.interpolate_times(df, ["trip"], block=2).collect()}
    assert out == {1: None, 2: 1000, 3: 2000, 4: 2500, 5: 3000, 6: None, 7: None}


def test_weather_falls_back_to_later_then_earlier_hours(spark):
    readings = spark.createDataFrame(
        [(1, T0 + dt.timedelta(hours=3), 3.0), (1, T0 + dt.timedelta(hours=9), 9.0), (1, T0 + dt.timedelta(hours=9, minutes=30), 9.5)],
        "station int, ts timestamp, precipitation double",
    )
    rows = spark.createDataFrame(
        [(0, 1, T0 + dt.timedelta(hours=9, minutes=20)), (1, 1, T0 + dt.timedelta(hours=5)), (2, 1, T0 + dt.timedelta(hours=23)), (3, 2, T0)],
        "id int, station int, ts timestamp",
    )
    got = {r["id"]: r["precipitation"] for r in enrich.asof_weather(rows, readings, ["id"]).collect()}
    assert got == {0: 9.5, 1: 9.0, 2: 9.5, 3: None}


def test_bunching_pairs_take_the_nearest_in_time(spark):
    near = lambda i, bus, s, lat: (i, T0.date(), "r", 1, bus, T0 + dt.timedelta(seconds=s), lat, -49.0)
    rows = [near(0, "a", 100, -25.0), near(1, "b", 103, -25.0), near(2, "b", 101, -25.5), near(3, "c", 104, -25.0001)]
    df = spark.createDataFrame(rows, "id long, date date, route string, shape int, bus string, ts timestamp, lat double, lon double")
    got = {(r["id_a"], r["id_b"]) for r in bunching.bunching_pairs(df).collect()}
    # Ping 0 meets ping 2 of bus b first, which is far away, so only bus c is left for it.
    assert got == {(0, 3), (3, 0), (1, 0), (1, 3), (3, 1)}


@pytest.mark.parametrize(
    "firsts, lasts, want",
    [
        ([2, 9, 15], [], [(2, 9, False), (10, 15, False)]),
        ([], [4, 8], [(4, 8, False)]),
        ([3], [], []),
        ([1, 10], [5, 15], [(1, 5, False), (10, 15, False)]),
        # A start before the last end splits the trip before it; the end after it stays open.
        ([1, 3, 9], [5, 12], [(1, 3, True), (4, 5, False), (9, 12, False)]),
        # An end before the start closes nothing and marks a broken stretch, but not on the first trip.
        ([4, 20], [2, 8, 15, 30], [(4, 8, False), (8, 15, True), (20, 30, False)]),
    ],
)
def test_trip_pairing(spark, firsts, lasts, want):
    rows = [(T0.date(), "b", 1, "FIRST", i) for i in firsts] + [(T0.date(), "b", 1, "LAST", i) for i in lasts]
    closest = spark.createDataFrame(rows, "day date, bus string, shape int, kind string, idx long")
    out = matching.pair_trips(closest).orderBy("trip_num").collect()
    assert [(r["first_idx"], r["last_idx"], r["broken"]) for r in out] == want
    assert [r["trip_num"] for r in out] == list(range(1, len(want) + 1))


def test_a_vehicle_running_two_trips(spark):
    """Out and back on opposite shapes: every ping keeps its place, pings outside trips are outliers."""
    out_line = [(1, "L", i, i * 100.0, -25.0, -49.0 + i * 0.001) for i in range(1, 41)]
    back_line = [(2, "L", i, i * 100.0, -25.0, -49.0 + (41 - i) * 0.001) for i in range(1, 41)]
    third = [(3, "L", i, i * 100.0, -26.0, -49.0 + i * 0.001) for i in range(1, 41)]
    shapes = spark.createDataFrame(out_line + back_line + third, "shape long, route string, seq long, dist double, lat double, lon double")
    lons = [-48.999 + i * 0.001 for i in range(40)]
    path = lons + lons[::-1] + lons + lons[::-1]
    rows = [(T0.date(), "bus", i, T0 + dt.timedelta(seconds=60 * i), "L", -25.0, x) for i, x in enumerate(path)]
    pings = spark.createDataFrame(rows, "day date, bus string, gps_id long, ts timestamp, line_code string, lat double, lon double")
    lines = matching.shape_lines(shapes)
    numbered = matching.number_pings(pings)
    vehicles = matching.vehicle_lines(numbered)
    closest = matching.closest_per_tag(matching.tag_candidates(matching.candidate_points(numbered, vehicles, lines)))
    pairs = matching.pair_trips(closest)
    chosen = matching.choose_shapes(pairs, vehicles, lines)
    assert {r["shape"] for r in chosen.collect()} == {1, 2}
    trips = matching.build_trips(pairs, chosen)
    # Shape 2 has the longer first trip and is taken first; the trips of its partner would overlap.
    spans = sorted((r["shape"], r["first_idx"], r["last_idx"]) for r in trips.collect())
    assert spans == [(2, 39, 79), (2, 119, 159)]
    done = matching.outlier_points(matching.assign_trip(numbered, trips), trips).toPandas()
    assert len(done) == len(rows) and done["idx"].is_unique
    assert set(done["trip_problem"]) <= {"NO_PROBLEM", "TRIP_PROBLEM", "OUTLIER_POINT"}
    assert (done["trip_problem"] == "NO_PROBLEM").sum() == 82
    assert done.sort_values("idx")["trip_num"].tolist() == [1] * 119 + [2] * 41


def test_upsert_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "id long, ts timestamp, v string"

    def land(rows):
        spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), v) for i, m, v in rows], schema).write.mode("append").parquet(source)

    def run():
        stream = feeds.read_feed(spark, source, schema)
        feeds.upsert_stream(stream, "id", "ts", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        return {r["id"]: r["v"] for r in feeds.read_upserted(spark, "id", "ts", str(tmp_path / "out")).collect()}

    land([(1, 0, "a"), (2, 0, "b"), (1, 5, "c")])
    assert run() == {1: "c", 2: "b"}
    land([(1, 3, "late"), (2, 9, "new"), (3, 1, "x")])
    assert run() == {1: "c", 2: "new", 3: "x"}


def test_models_keep_rows_with_null_features(spark):
    from busweave.operators import learning

    rows = [(i, None if i % 3 == 0 else float(i), float(i % 7), int(i > 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    model = learning.fit_classifier(df, ["a", "b"], "y", "tree")
    got = learning.predict(model, df)
    assert got.count() == 60 and got.columns == ["id", "a", "b", "y", "prediction"]
    assert got.where("a IS NULL").count() == 20


def test_csv_columns_go_by_name(spark, tmp_path):
    from busweave.sources import readers

    (tmp_path / "a.csv").write_text('more,street,uuid,confidence,pubMillis,location\n1,"Old, road",u1,7,1000,"{""x"": -49.5, ""y"": -25.5}"\n2,,u2,bad,,\n')
    got = {r.alert_id: r for r in readers.read_alerts(spark, str(tmp_path / "a.csv")).collect()}
    assert (got["u1"].street, got["u1"].confidence, got["u1"].lon, got["u1"].lat) == ("Old, road", 7, -49.5, -25.5)
    assert got["u2"].street is None and got["u2"].confidence is None and got["u2"].ts is None and got["u1"].roadType is None
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "1.csv").write_text("uuid,street\nu,s\n")
    (folder / "2.csv").write_text("street,uuid\ns,u\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_named_csv(spark, str(folder), "uuid string, street string").collect()


def test_trips_are_clipped_shape_by_shape(spark):
    pairs = [("d", "b", 1, 1, 39, 79, False), ("d", "b", 2, 1, 0, 38, False), ("d", "b", 2, 2, 60, 120, True)]
    pairs = spark.createDataFrame(pairs, "day string, bus string, shape long, trip_num int, first_idx long, last_idx long, broken boolean")
    pairs = pairs.withColumn("day", F.lit("2024-05-01").cast("date"))
    chosen = pairs.select("day", "bus", "shape", F.col("shape").cast("int").alias("rank")).distinct()
    got = [tuple(r) for r in matching.build_trips(pairs, chosen).select("shape", "trip_num", "first_idx", "last_idx").collect()]
    assert sorted(got) == [(1, 1, 39, 79), (2, 2, 80, 120)]


def test_nearest_point_across_the_date_line(spark):
    left = spark.createDataFrame([(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 10.0, 20.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(1, 0.0, 179.5), (2, 0.0, -179.99), (3, 0.0, 179.995)] + [(9 + i, 10.0, 21.0 + i) for i in range(9)], "pid long, lat double, lon double")
    right = right.where("pid <> 3")
    got = {r.id: r.pid for r in nearest_point(left, right, ["id"], [], ["pid"], ["pid"]).collect()}
    assert got == {1: 2, 2: 2, 3: 9}
