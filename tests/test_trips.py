"""Trip pairing and clipping against the same rules written as plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from busweave.operators import matching


def pair(firsts, lasts):
    """Start points look for the next end point; start points inside the trip before them split it."""
    if not firsts or not lasts:
        only = firsts or lasts
        return [(a + (n > 0), b, False) for n, (a, b) in enumerate(zip(only, only[1:]))]
    trips, rest, closed = [], list(lasts), 0
    for n, start in enumerate(firsts):
        if not rest:
            break
        if n and start <= closed:
            if trips:
                a, b, _ = trips.pop()
                trips += [(a, start, True), (start + 1, b, False)]
            continue
        while rest:
            end = rest.pop(0)
            if end > start:
                trips.append((start, end, False))
                closed = end
                break
            if n:
                trips.append((closed, end, True))
    return trips


def clip(trips):
    starts, ends, out = {}, {}, []
    for rank, shape, n, first, last in sorted(trips):
        first = max([first] + [ends[m] + 1 for m in (n - 1, n) if m in ends])
        last = min([last] + ([starts[n + 1]] if n + 1 in starts else []))
        if n in ends and first > ends[n] + 1:
            ends[n] = first
        if first < last:
            out.append((shape, n, first, last))
            starts.setdefault(n, first)
            ends[n] = last
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_groups(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for shape in range(600):
        top = rng.choice([6, 12, 40])
        firsts = sorted(rng.sample(range(top), rng.randint(0, min(top, 9))))
        lasts = sorted(rng.sample(range(top), rng.randint(0, min(top, 9))))
        rows += [("2024-05-01", 7, shape, "FIRST", i) for i in firsts] + [("2024-05-01", 7, shape, "LAST", i) for i in lasts]
        want += [(shape, n, *trip) for n, trip in enumerate(pair(firsts, lasts), 1)]
    closest = spark.createDataFrame(rows, "day string, bus int, shape int, kind string, idx int").withColumn("day", F.to_date("day"))
    got = matching.pair_trips(closest)
    assert got.dtypes == [("day", "date"), ("bus", "string"), ("shape", "bigint"), ("trip_num", "int"), ("first_idx", "bigint"), ("last_idx", "bigint"), ("broken", "boolean")]
    assert sorted((r.shape, r.trip_num, r.first_idx, r.last_idx, r.broken) for r in got.collect()) == sorted(want)


def test_random_clipping(spark):
    rng = random.Random(4)
    pairs, chosen, want = [], [], []
    for bus in range(150):
        trips = []
        for shape in range(rng.randint(1, 3)):
            rank = rng.randint(1, 2)
            chosen.append(("2024-05-01", str(bus), shape, rank))
            for n in range(1, rng.randint(2, 6)):
                first = rng.randint(0, 60)
                trips.append((rank, shape, n, first, first + rng.randint(0, 30)))
        pairs += [("2024-05-01", str(bus), shape, n, a, b, n % 2 == 0) for _, shape, n, a, b in trips]
        want += [(str(bus), *row) for row in clip(trips)]
    pairs = spark.createDataFrame(pairs, "day string, bus string, shape long, trip_num int, first_idx long, last_idx long, broken boolean")
    chosen = spark.createDataFrame(chosen, "day string, bus string, shape long, rank int")
    out = matching.build_trips(pairs.withColumn("day", F.to_date("day")), chosen.withColumn("day", F.to_date("day"))).collect()
    assert sorted((r.bus, r.shape, r.trip_num, r.first_idx, r.last_idx) for r in out) == sorted(want)
    assert all(r.problem == ("TRIP_PROBLEM" if r.trip_num % 2 == 0 else "NO_PROBLEM") for r in out)


def test_no_python_in_the_plan(spark):
    closest = spark.createDataFrame([("2024-05-01", "b", 1, "FIRST", 1)], "day string, bus string, shape long, kind string, idx long")
    pairs = matching.pair_trips(closest)
    chosen = pairs.select("day", "bus", "shape", F.lit(1).alias("rank"))
    plan = matching.build_trips(pairs, chosen)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
