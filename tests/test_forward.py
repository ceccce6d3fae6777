"""Walk-forward least squares against a fit of its own before each origin."""

import numpy as np
import pytest

from busweave.operators import forward, learning


def invented(n, holes):
    rng = np.random.default_rng(5)
    x = rng.normal([1000.0, -3.0, 0.5], [2.0, 1.0, 0.1], (n, 3))
    y = 7 + x @ [0.5, -2.0, 30.0] + rng.normal(0, 0.3, n)
    day = rng.integers(0, 30, n)
    gone = rng.random((n, 3)) < holes
    return [(i, int(day[i]), *[None if g else float(v) for g, v in zip(gone[i], x[i])], None if i % 41 == 0 else float(y[i])) for i in range(n)]


def refit(rows, origins):
    out = {}
    for k, origin in enumerate(origins):
        upper = origins[k + 1] if k + 1 < len(origins) else 10**9
        train = [r for r in rows if r[1] < origin and r[5] is not None]
        asked = [r for r in rows if origin <= r[1] < upper]
        x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in train], float).reshape(-1, 3)
        if not len(x):
            out.update({r[0]: None for r in asked})
            continue
        means = np.nanmean(x, axis=0)
        fill = lambda a: np.where(np.isnan(a), means, a)
        design = np.column_stack([np.ones(len(x)), fill(x)])
        weights = np.linalg.lstsq(design, np.array([r[5] for r in train]), rcond=None)[0]
        for r in asked:
            v = fill(np.array([np.nan if c is None else c for c in r[2:5]], float))
            out[r[0]] = float(weights[0] + v @ weights[1:])
    return out


SCHEMA = "id int, day int, a double, b double, c double, y double"


@pytest.mark.parametrize("holes", [0.0, 0.2])
@pytest.mark.parametrize("origins", [[10, 20], list(range(0, 30))])
def test_every_origin_equals_its_own_fit(spark, holes, origins):
    rows = invented(800, holes)
    df = spark.createDataFrame([*rows, (9999, None, 1.0, 1.0, 1.0, 1.0)], SCHEMA).repartition(3)
    out = forward.walk_forward_ols(df, ["a", "b", "c"], "y", "day", origins)
    assert out.columns == [*df.columns, "prediction"]
    got, want = {r.id: r.prediction for r in out.collect()}, refit(rows, origins)
    assert set(got) == set(want)
    assert {i for i, p in got.items() if p is None} == {i for i, p in want.items() if p is None}
    # Fits of fewer rows than weights have no single answer; all others are compared.
    keys = [r[0] for r in rows if want.get(r[0]) is not None and sum(x[1] < max(o for o in origins if o <= r[1]) for x in rows) > 20]
    assert len(keys) > 300
    np.testing.assert_allclose([got[i] for i in keys], [want[i] for i in keys], rtol=1e-8)


def test_equals_the_library_fit(spark):
    df = spark.createDataFrame(invented(400, 0.1), SCHEMA).where("y IS NOT NULL")
    model = learning.fit_regressor(df.where("day < 15"), ["a", "b", "c"], "y", "ols")
    want = {r.id: r.prediction for r in model.transform(df.where("day >= 15")).collect()}
    got = {r.id: r.prediction for r in learning.walk_forward(df, ["a", "b", "c"], "y", "day", [15]).collect()}
    assert set(got) == set(want)
    np.testing.assert_allclose([got[i] for i in want], [want[i] for i in want], rtol=1e-7)


def test_one_pass_whatever_the_number_of_origins(spark):
    df = spark.createDataFrame(invented(100, 0.0), SCHEMA)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for group, origins in (("few", [10]), ("many", list(range(1, 29)))):
        spark.sparkContext.setJobGroup(group, group)
        forward.origin_models(df, ["a"], "y", "day", origins)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_unusual_rows(spark):
    same = spark.createDataFrame([(i, i, 1.0, None, float("nan"), float(i)) for i in range(6)], SCHEMA)
    got = {r.id: r.prediction for r in forward.walk_forward_ols(same, ["a", "b", "c"], "y", "day", [2, 4]).collect()}
    assert got == pytest.approx({2: 0.5, 3: 0.5, 4: 1.5, 5: 1.5})
    assert forward.walk_forward_ols(same.limit(0), ["a"], "y", "day", [2]).count() == 0
    with pytest.raises(ValueError):
        forward.origin_models(same, ["a"], "y", "day", [4, 2])
