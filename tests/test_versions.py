"""Upserts by id and day over several batches, with late rows, restarts and batches that run again."""

import datetime as dt
import shutil

import pytest

from busweave.streaming import feeds, versions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, v string, n int"


@pytest.fixture
def feed(spark, tmp_path):
    class Feed:
        target, mark = str(tmp_path / "out"), str(tmp_path / "mark")

        def land(self, rows):
            made = [(i, None if h is None else T0 + dt.timedelta(hours=h), v, n) for i, h, v, n in rows]
            spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def run(self, mark=None):
            stream = feeds.read_feed(spark, str(tmp_path / "in"), SCHEMA)
            query = versions.upsert_by_day(stream, "id", "ts", self.target, mark or self.mark, tie="n")
            query.awaitTermination()
            return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) if query.lastProgress else None

        def rows(self):
            out = versions.read_by_day(spark, self.target)
            assert out.columns == ["id", "ts", "v", "n", "day"]
            return sorted((r.id, r.day.day, (r.ts - T0).total_seconds() / 3600, r.v) for r in out.collect())

    return Feed()


def test_batches_late_rows_and_restarts(spark, feed):
    feed.land([(1, 0, "a", 1), (2, 1, "b", 1), (1, 5, "c", 1), (None, 5, "no id", 1), (9, None, "no time", 1)])
    feed.run()
    assert feed.rows() == [(1, 1, 5, "c"), (2, 1, 1, "b")]
    # An older version and one that loses the tie change nothing, whatever the order of arrival.
    feed.land([(1, 4.5, "older", 9), (2, 9, "new", 2), (2, 9, "less", 1), (2, 9, "null", None)])
    feed.run()
    assert feed.rows() == [(1, 1, 5, "c"), (2, 1, 9, "new")]
    # The next day begins; past its first hour the day before is settled and leaves the state.
    feed.land([(1, 26, "next", 1), (3, 23, "y", 1)])
    assert feed.run() == 1
    feed.land([(2, 20, "too late", 9), (4, 27, "z", 1), (1, 27, "again", 1)])
    assert feed.run() == 2
    want = [(1, 1, 5, "c"), (1, 2, 27, "again"), (2, 1, 9, "new"), (3, 1, 23, "y"), (4, 2, 27, "z")]
    assert feed.rows() == want
    feed.run()  # nothing new
    assert feed.rows() == want
    settled = spark.read.parquet(feed.target + "/settled")
    assert settled.count() == settled.select("id", "day").distinct().count() == 3
    plan = settled.where("day = '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_batch_that_runs_again_adds_nothing(spark, feed, tmp_path):
    feed.land([(1, 1, "a", 1), (2, 2, "b", 1)])
    feed.run()
    shutil.copytree(feed.mark, str(tmp_path / "mark-before"))
    feed.land([(1, 30, "c", 1), (2, 31, "d", 1), (2, 3, "late", 1)])
    feed.run()
    want = feed.rows()
    feed.run(str(tmp_path / "mark-before"))  # as after a failure before the batch was noted as done
    assert feed.rows() == want == [(1, 1, 1, "a"), (1, 2, 30, "c"), (2, 1, 3, "late"), (2, 2, 31, "d")]


def test_reads_do_not_grow_with_versions(spark, feed):
    for turn in range(4):
        feed.land([(i, 24 * turn + h, f"{turn}-{h}", 1) for i in range(5) for h in range(2, 20)])
        state = feed.run()
        assert state == 5
    read = versions.read_by_day(spark, feed.target)
    assert read.count() == 20 and {r.v for r in read.collect()} == {f"{turn}-19" for turn in range(4)}
    assert spark.read.parquet(feed.target + "/settled").count() == 15
    assert spark.read.parquet(feed.target + "/open").where("NOT __mark").count() <= 2 * 10


def test_other_streams_keep_their_state_store(spark, feed):
    before = spark.conf.get(versions.PROVIDER, None)
    feed.land([(1, 1, "a", 1)])
    feed.run()
    assert spark.conf.get(versions.PROVIDER, None) == before
    with pytest.raises(ValueError):
        versions.read_by_day(spark, feed.target + "-none")


def test_state_is_an_aggregate_and_the_first_of_equal_versions_stays(spark, feed):
    feed.land([(1, 1, "first", 1), (1, 1, "equal", 1), (2, 1, "old", 1), (2, 1, "newer", 2)])
    stream = feeds.read_feed(spark, feed.target.replace("out", "in"), SCHEMA)
    query = versions.upsert_by_day(stream, "id", "ts", feed.target, feed.mark, tie="n")
    query.awaitTermination()
    assert [s["operatorName"] for s in query.lastProgress["stateOperators"]] == ["stateStoreSave"]  # no calls per key
    feed.land([(1, 1, "later batch", 1), (2, 1, "less", 1)])
    feed.run()
    assert feed.rows() == [(1, 1, 1, "first"), (2, 1, 1, "newer")]


@pytest.mark.parametrize("delay,ms", [("1 hour", 3_600_000), ("30 hours 5 minutes", 108_300_000), ("1 month 2 days", 33 * 86_400_000)])
def test_delays_are_those_of_a_watermark(spark, delay, ms):
    assert versions._delay_ms(spark, delay) == ms
