"""Continued training against hand calculations."""

import math

import pytest
from pyspark.sql import functions as F

from busweave.operators import continued as C

LEFT = [(0.0, 1)] * 3 + [(0.0, 0)] * 5 + [(1.0, 1)] * 6 + [(1.0, 0)] * 2
RIGHT = [(0.0, 1)] * 4 + [(0.0, 0)] * 4 + [(1.0, 1)] * 1 + [(1.0, 0)] * 7


def frame(spark, rows):
    return spark.createDataFrame([(x, y, i) for i, (x, y) in enumerate(rows)], "x double, y int, score int")


def by_hand(slices, rounds, rate):
    """Margins of both values of x after each slice, one Newton step of each group a round."""
    first = [y for _, y in slices[0]]
    start = math.log((sum(first) + 0.5) / (len(first) - sum(first) + 0.5))
    margin, out = {0.0: start, 1.0: start}, []
    for rows in slices:
        share = {v: sum(y for x, y in rows if x == v) / sum(1 for x, _ in rows if x == v) for v in margin}
        for _ in range(rounds):
            for v in margin:
                p = 1 / (1 + math.exp(-margin[v]))
                margin[v] += rate * (share[v] - p) / (p * (1 - p))
        out.append(dict(margin))
    return out


@pytest.mark.parametrize("rounds", [1, 7])
def test_boosting_equals_newton_steps(spark, rounds):
    slices = [LEFT, RIGHT]
    chains = C.continue_slices([frame(spark, s) for s in slices], C.continue_boosting, ["x"], "y", rounds=rounds, rate=0.4, depth=1)
    asked = frame(spark, [(0.0, 0), (1.0, 0)])
    for chain, want in zip(chains, by_hand(slices, rounds, 0.4)):
        assert {r.x: r.margin for r in C.predict_chain(chain, asked).collect()} == pytest.approx(want, abs=1e-9)
    assert len(chains[1].parts) == 2 * rounds and chains[1].parts[:rounds] == chains[0].parts


def test_logistic_offset_fits_only_what_is_left(spark):
    """A group's fitted margin is the log-odds of the last slice, whatever came before, and a slice like the last adds nothing."""
    chains = C.continue_slices([frame(spark, s) for s in (LEFT, RIGHT, RIGHT)], C.continue_logistic, ["x"], "y")
    asked = frame(spark, [(0.0, 0), (1.0, 0)])
    want = [{0.0: math.log(3 / 5), 1.0: math.log(6 / 2)}] + [{0.0: 0.0, 1.0: math.log(1 / 7)}] * 2
    for chain, margins in zip(chains, want):
        assert {r.x: r.margin for r in C.predict_chain(chain, asked).collect()} == pytest.approx(margins, abs=1e-6)
    last = chains[2].parts[-1][0]
    assert list(last.coefficients) == pytest.approx([0.0], abs=1e-6) and last.intercept == pytest.approx(0.0, abs=1e-6)


def test_later_slices_improve_what_the_first_did_not_hold(spark):
    """The second slice has values that the first lacks; held-out rows of both are scored better after it."""
    first = [(float(i % 5), int(i % 5 > 2)) for i in range(200)]
    second = [(float(10 + i % 5), int(i % 5 < 2)) for i in range(200)]
    chains = C.continue_slices([frame(spark, first), frame(spark, second)], C.continue_boosting, ["x"], "y", rounds=6, depth=3)
    held = frame(spark, [(float(v), int(v > 2)) for v in range(5)] + [(10.0 + v, int(v < 2)) for v in range(5)])
    right = [C.predict_chain(c, held).where("prediction = y").count() for c in chains]
    assert right[0] < 10 and right[1] == 10


def test_unusual_rows(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 0), (1.0, 1), (0.0, 0), (2.0, None)], "x double, y int")
    chain = C.continue_boosting(df, ["x"], "y", rounds=2, depth=1)
    out = C.predict_chain(chain, df.withColumn("margin", F.lit("mine")))
    assert out.columns == ["x", "y", "margin", "score", "prediction"]
    assert out.where("score > 0 AND score < 1").count() == 5
    one = C.continue_boosting(df.where("y = 1"), ["x"], "y", rounds=2)
    assert C.predict_chain(one, df).where("score > 0.5").count() == 5
    with pytest.raises(ValueError):
        C.continue_boosting(df.limit(0), ["x"], "y")
