"""Integrated rows by hand: neutral and found reports, threshold by timetable, layouts, gaps; nearest rows of equal id."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from busweave.operators import headway as H
from busweave.operators import integrated as N
from busweave.operators.nearest import nearest_point
from busweave.operators.shaping import feature_group
from busweave.session import checkpointed

DAY = "2024-03-04 "  # a Monday
VISIT = "visit_id string, day date, route string, trip_num int, shape int, frequency string, seq int, shape_lat double, shape_lon double, dist double, bus int, gps_id long, gps_lat double, gps_lon double, distance_m double, ts timestamp, stop int, problem string, cell int, street string"
ALERT = "alert_id long, cell int, street string, ts timestamp, lat double, lon double, alert_subtype string, alert_type string, alert_road_type int, alert_confidence int, alert_comments int, alert_images int, alert_thumbs int, alert_reliability int, alert_mood int, alert_rating double, alert_speed double, alert_unified boolean, alert_in_scale boolean"
JAM = "jam_id long, street string, ts timestamp, jam_expiry timestamp, jam_block_type string, jam_delay int, jam_length int, jam_level int, jam_severity int, jam_speed double"


def at(clock):
    return datetime.fromisoformat(DAY + clock)


@pytest.fixture(scope="module")
def rows(spark):
    def visit(name, bus, clock, ping=True, street="Main"):
        seen = (7, -25.001, -49.0, 3.5) if ping else (None, None, None, None)
        return (name, at("00:00:00").date(), "R", 1, 1, "high", 5, -25.0, -49.0, 100.0, bus, *seen, at(clock), 9, "NO_PROBLEM" if ping else "BETWEEN", 1, street)

    visits = spark.createDataFrame(
        [visit("a", 1, "08:00:00"), visit("b", 2, "08:04:00", ping=False), visit("c", 3, "08:20:00"), visit("d", 3, "08:50:00", street="-"), visit("e", 1, "12:00:00", street="Other")], VISIT
    )
    stations = spark.createDataFrame([(1, -25.0, -49.01), (2, -26.0, -49.0)], "station int, lat double, lon double")
    readings = spark.createDataFrame([(1, at("08:10:00"), 1.5), (1, at("08:30:00"), 2.5), (2, at("08:00:00"), 9.0)], "station int, ts timestamp, precipitation double")
    alert = (4, 1, "Main Street", at("07:30:00"), -25.0, -49.0, None, "JAM", 2, 3, 0, 0, 1, 7, None, 2.0, 4.5, True, False)
    jam = (6, "Main Street", at("08:05:00"), None, None, 60, 200, 3, 2, 5.5)
    return N.integrate(visits, stations, readings, spark.createDataFrame([alert], ALERT), spark.createDataFrame([jam], JAM)).cache()


def test_reports_and_neutral_ones(rows):
    got = {r.visit_id: r for r in rows.collect()}
    assert sorted(got) == ["a", "b", "c", "d", "e"]
    a, b, e = got["a"], got["b"], got["e"]
    assert (a.alert_type, a.alert_subtype, a.alert_mood, a.alert_confidence, a.alert_ts, a.alert_m) == ("JAM", None, None, 3, at("07:30:00"), 0.0)
    assert (a.jam_block_type, a.jam_level, a.jam_ts) == (None, 3, at("08:05:00"))
    assert (a.precipitation, a.reading_ts) == (1.5, at("08:10:00"))
    assert (b.alert_type, b.alert_lat, b.gps_id) == ("JAM", -25.0, None)
    assert (e.alert_type, e.alert_subtype, e.alert_confidence, e.alert_reliability, e.alert_rating, e.alert_speed) == ("NORMAL", "NORMAL", 5, 10, 5.0, None)
    assert (e.alert_ts, e.alert_lat, e.alert_m, e.jam_ts, e.jam_block_type, e.jam_level) == (at("12:00:00"), -25.001, 3.5, at("12:00:00"), "NORMAL", 0)
    assert got["d"].alert_type == "NORMAL"
    assert len(N.integrated_columns(rows).columns) == 44


def test_label_layouts_and_features(spark, rows):
    scheduled = spark.createDataFrame([("R", 1, 9, 4, 28800, 29700, 40)], "route string, shape int, stop int, service_id int, first_arr int, second_arr int, sched_min long")
    flags = {d: int(d == "monday") for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")}
    calendar = spark.createDataFrame([{"service_id": 4, "start_date": datetime(2024, 1, 1).date(), "end_date": datetime(2024, 12, 31).date(), **flags}])
    labelled = N.label_visits(rows, scheduled, calendar)
    got = {r.visit_id: (r.sb.bus, r.headway_min, r.threshold_min, r.bunched) for r in labelled.collect()}
    # a and b lie in the interval of 40 minutes; c is followed by its own bus; the others have no interval.
    assert got == {"a": (2, 4, 10, True), "b": (3, 16, 5, False), "d": (1, 190, 5, False)}
    wide = N.labelled_columns(labelled)
    assert len(wide.columns) == 89 and wide.columns[44:48] == ["headway", "headwayThreshold", "busBunching", "GPShour"]
    dated = N.with_date_features(wide)
    assert len(dated.columns) == 111
    assert {r[0] for r in dated.select("WEEKDAY(gps_datetimeSB)").collect()} == {0}
    assert len(feature_group(dated, "gps", "gtfs").columns) == 39
    assert len(feature_group(dated, "weather").columns) == 12
    assert len(feature_group(dated, "traffic").columns) == 60
    full = {r.busCode: r for r in N.model_rows(dated).collect()}
    assert full[2].gpsPointId == 0 and full[2].gpsLat == -25.0 and full[2].distanceToShapePoint == 0
    assert {r.alertSpeed for r in full.values()} == {4.5} and {r.alertInScale for r in full.values()} == {0}
    assert [r.alertReportMood for r in full.values()] == [None] * 3  # null all through the weekday


@pytest.mark.parametrize("places", [10, 200])
def test_rows_of_equal_or_null_id_stay(spark, places):
    points = spark.range(places).select(F.col("id").alias("p"), (F.lit(-25.0) + F.col("id") * 1e-6).alias("lat"), F.lit(-49.0).alias("lon"))
    left = spark.createDataFrame([(1, -25.0, -49.0), (1, -25.0, -49.0), (1, -24.0, -49.0), (None, -26.0, -49.0), (2, None, -49.0)], "i int, lat double, lon double")
    got = nearest_point(left, points, ["i"], [], ["p"], ["p"], size=0.5).collect()
    assert sorted((str(r.i), str(r.lat), r.p) for r in got) == sorted(
        [("1", "-25.0", 0), ("1", "-25.0", 0), ("1", "-24.0", places - 1), ("None", "-26.0", 0), ("2", "None", None)], key=lambda r: (r[0], r[1])
    )


def test_services_of_dates_are_written_and_rows_are_paired_once(spark):
    rows = spark.sql("SELECT id, timestamp'2024-01-01 08:00:00' + make_interval(0, 0, 0, int(id % 3)) AS ts FROM range(9)")
    week = ", ".join(f"int({day} <= 5) AS {name}" for day, name in enumerate("monday tuesday wednesday thursday friday saturday sunday".split(), 1))
    calendar = spark.sql(f"SELECT 7 AS service_id, date'2024-01-01' AS start_date, date'2024-01-02' AS end_date, {week}")
    out = H.service_for_day(rows, calendar)
    assert any("busweave-services" in f for f in out.inputFiles())
    assert sorted((r.id, r.service_id) for r in out.collect()) == [(i, 1 if i % 3 == 2 else 7) for i in range(9)]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line[line.index("hashpartitioning(") :] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _small_integrated(spark):
    visits = spark.createDataFrame([("a", at("00:00:00").date(), "R", 1, 1, "high", 5, -25.0, -49.0, 100.0, 1, 7, -25.0, -49.0, 3.5, at("08:00:00"), 9, "x", 1, "Main")], VISIT)
    stations = spark.createDataFrame([(1, -25.0, -49.01)], "station int, lat double, lon double")
    readings = spark.createDataFrame([(1, at("08:10:00"), 1.5)], "station int, ts timestamp, precipitation double")
    return N.integrate(visits, stations, readings, spark.createDataFrame([], ALERT), spark.createDataFrame([], JAM))


def test_found_reports_are_shuffled_once_by_visit(spark, shuffled_joins):
    by_visit = [e for e in _exchanges(_small_integrated(spark)) if "visit_id" in e]
    assert len(by_visit) == 4  # the visits, and the result of each lookup where it is grouped


def test_pairs_are_not_shuffled_by_visit(spark, rows):
    scheduled = spark.createDataFrame([("R", 1, 9, 4, 28800, 29700, 40)], "route string, shape int, stop int, service_id int, first_arr int, second_arr int, sched_min long")
    calendar = spark.sql("SELECT 4 AS service_id, date'2024-01-01' AS start_date, date'2024-12-31' AS end_date, 1 AS monday, 0 AS tuesday, 0 AS wednesday, 0 AS thursday, 0 AS friday, 0 AS saturday, 0 AS sunday")
    rows = checkpointed(rows, "rows")
    labelled = N.label_visits(rows, scheduled, calendar)
    assert not [e for e in _exchanges(labelled) if "visit_id" in e]
    some = N.labelled_columns(N.label_visits(rows, scheduled, calendar, carry=["ts", "bus"]))
    assert [c for c in some.columns if c.endswith("SB")] == ["busCodeSB", "gps_datetimeSB"]
    assert sorted(map(str, some.collect())) == sorted(map(str, N.labelled_columns(labelled).select(some.columns).collect()))


@pytest.mark.parametrize("most", [0, 1000])
def test_scheduled_interval_of_repeated_and_null_ids(spark, monkeypatch, most):
    """Listed or joined, pairs of one id share the earliest interval, null ids have none."""
    monkeypatch.setattr(H, "LIST_ENTRIES", most)
    scheduled = spark.createDataFrame([(1, 0, 4000, 66), (1, 0, 4000, 66), (1, 4000, 9000, 83), (2, 0, 9000, 150), (None, 0, 9000, 150)], "k int, first_arr int, second_arr int, sched_min long")
    pairs = spark.createDataFrame(
        [("a", 1, 10, 20), ("b", 1, 3999, 4001), ("c", 1, 5000, 6000), ("c", 1, 100, 200), ("d", 2, 9000, 9000), (None, 2, 1, 2), ("e", None, 1, 2), ("f", 1, 200, 100)], "id string, k int, t1_s int, t2_s int"
    )
    got = H.scheduled_headway_for(pairs, scheduled, "id", ["k"])
    assert got.columns == ["id", "k", "t1_s", "t2_s", "sched_min"]
    assert sorted((str(r.id), r.t1_s, r.sched_min) for r in got.collect()) == sorted(
        [("a", 10, 66), ("b", 3999, None), ("c", 5000, 66), ("c", 100, 66), ("d", 9000, 150), ("None", 1, None), ("e", 1, None), ("f", 200, None)]
    )
