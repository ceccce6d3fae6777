"""Stacking out of fold and adaptive boosting by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from busweave.operators import learning
from busweave.operators.adaboost import fit_adaboost, predict_adaboost
from busweave.operators.features import row_hash


def noise(spark, n=240):
    rng = random.Random(8)
    return spark.createDataFrame([(f"k{i}", float(i), rng.randrange(2), i % 5 != 0) for i in range(n)], "k string, x double, y int, is_train boolean")


DEEP = {"tree": {"maxDepth": 25, "maxBins": 256}}


def test_no_input_comes_from_a_model_that_saw_the_row(spark):
    """Labels are noise: a deep tree repeats those it saw and guesses the others."""
    df = noise(spark)
    out = learning.stack(df, ["x"], "y", ["tree", "logistic"], "k", train="is_train", folds=4, params=DEEP)
    assert out.columns == [*df.columns, "pred_tree", "pred_logistic"] and out.count() == df.count()
    right = out.where("is_train").agg(F.avg((F.col("pred_tree") == F.col("y")).cast("int"))).first()[0]
    seen = learning.predict(learning.fit_classifier(df, ["x"], "y", "tree", **DEEP["tree"]), df)
    assert seen.where("prediction = y").count() == df.count()
    assert 0.3 < right < 0.7


def test_predictions_are_those_of_the_other_folds(spark):
    df = noise(spark)
    got = {r.k: r.pred_tree for r in learning.stack(df, ["x"], "y", ["tree"], "k", train="is_train", folds=3, params=DEEP).collect()}
    dealt = df.withColumn("fold", row_hash("k") % 3)
    want = {}
    for f in range(3):
        model = learning.fit_classifier(dealt.where(f"is_train AND fold <> {f}"), ["x"], "y", "tree", **DEEP["tree"])
        want.update({r.k: r.prediction for r in learning.predict(model, dealt.where(f"is_train AND fold = {f}")).collect()})
    model = learning.fit_classifier(dealt.where("is_train"), ["x"], "y", "tree", **DEEP["tree"])
    want.update({r.k: r.prediction for r in learning.predict(model, dealt.where("NOT is_train")).collect()})
    assert got == want


def test_boosting_learns_from_training_rows_only(spark):
    df = noise(spark)
    flipped = df.withColumn("y", F.when(F.col("is_train"), F.col("y")).otherwise(1 - F.col("y")))
    runs = [learning.boost_by_errors(d, ["x"], "y", ["tree", "logistic"], train="is_train") for d in (df, flipped)]
    a, b = ({r.k: (r.pred_tree, r.pred_logistic) for r in run.collect()} for run in runs)
    assert a == b and len(a) == df.count()


# One feature, five places; three stumps are needed.
POINTS = [(0.0, 1), (1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)]


def by_hand(points, rounds, rate):
    """Best stump of each round by Gini impurity of the weighted labels, as (cut, label left, label right)."""
    weights, out = [1.0] * len(points), []
    for _ in range(rounds):
        def impurity(side):
            total = sum(weights[i] for i in side)
            ones = sum(weights[i] for i in side if points[i][1])
            return total * (1 - (ones / total) ** 2 - (1 - ones / total) ** 2) if total else 0.0

        def label(side):
            ones, total = sum(weights[i] for i in side if points[i][1]), sum(weights[i] for i in side)
            return int(ones > total - ones)

        cuts = []
        for cut in range(1, len(points)):
            left, right = range(cut), range(cut, len(points))
            cuts.append((impurity(left) + impurity(right), cut, label(left), label(right)))
        _, cut, a, b = min(cuts)
        wrong = [(a if i < cut else b) != y for i, (_, y) in enumerate(points)]
        err = sum(w for w, bad in zip(weights, wrong) if bad) / sum(weights)
        alpha = rate * math.log((1 - err) / err)
        weights = [w * math.exp(alpha) if bad else w for w, bad in zip(weights, wrong)]
        out.append((err, alpha, cut, a, b))
    return out


def test_weights_and_votes_equal_a_hand_made_case(spark):
    df = spark.createDataFrame(POINTS, "x double, y int")
    want = by_hand(POINTS, 3, 1.0)
    vote = fit_adaboost(df, ["x"], "y", rounds=3)
    assert vote.errors == pytest.approx([w[0] for w in want]) and vote.alphas == pytest.approx([w[1] for w in want])
    got = {r.x: r.prediction for r in predict_adaboost(vote, df).collect()}
    scores = {x: sum(alpha * (1 if (a if i < cut else b) else -1) for _, alpha, cut, a, b in want) for i, (x, _) in enumerate(POINTS)}
    assert got == {x: int(s > 0) for x, s in scores.items()}
    assert got == dict(POINTS)  # no single stump gets all five right


def test_unusual_boosting_rows(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (None, 1), (5.0, None), (9.0, 2), (9.5, 2)], "x double, y int")
    vote = fit_adaboost(df, ["x"], "y", rounds=6, depth=3)
    out = predict_adaboost(vote, df.withColumn("prediction", F.lit("mine")))
    assert vote.classes == 3 and out.count() == 6 and out.columns == ["x", "y", "prediction"]
    assert {r.x: r.prediction for r in out.where("x IN (0, 1, 9)").collect()} == {0.0: 0, 1.0: 1, 9.0: 2}
    with pytest.raises(ValueError):
        fit_adaboost(df.limit(0), ["x"], "y")


def test_steps_are_prepared_once_and_equal_single_fits(spark, monkeypatch):
    df = noise(spark).withColumns({"a": (F.col("x") > 50).cast("int"), "b": (F.col("x") > 120).cast("int")})
    want = [learning.predict(learning.fit_classifier(df, ["x"], y, "tree", maxDepth=3), df).orderBy("k").collect() for y in ("a", "b")]
    calls, assemble = [], learning.assemble
    monkeypatch.setattr(learning, "assemble", lambda *a: calls.append(a) or assemble(*a))
    models = learning.fit_steps(df, ["x"], ["a", "b"], "tree", maxDepth=3)
    assert len(calls) == 1
    got = learning.predict_steps(models, df).orderBy("k").collect()
    assert [(r.pred_a, r.pred_b) for r in got] == [(a.prediction, b.prediction) for a, b in zip(*want)]


def test_boosted_rows_are_written_after_each_learner(spark):
    out = learning.boost_by_errors(noise(spark), ["x"], "y", ["tree", "logistic"], train="is_train")
    assert all("busweave-boost" in f for f in out.inputFiles()) and out.inputFiles()
