"""Adaptive boosting: weighted trees that vote, each looking harder at what those before it got wrong."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.operators.learning import SEED, assemble
from busweave.session import checkpointed

FEATURES, WEIGHT = "__features", "__weight"
WRITE_EVERY = 5


@dataclass(frozen=True)
class Vote:
    """Trees with the weight of their votes and the weighted error each was measured at, for labels 0 to classes - 1."""

    prepare: PipelineModel
    classes: int
    trees: tuple[Model, ...]
    alphas: tuple[float, ...]
    errors: tuple[float, ...]


def fit_adaboost(df: DataFrame, cols: Sequence[str], label: str, rounds: int = 50, rate: float = 1.0, depth: int = 1) -> Vote:
    """Rounds of reweighting over the labelled rows of ``df``, whose labels are 0, 1, … .

    With ``err`` the weighted share of wrong rows, a tree's vote weighs ``rate * (ln((1 - err) / err) + ln(classes - 1))``
    and the weight of wrong rows is multiplied by its exponential. Rounds end at a tree without error, which then
    decides alone if it is the first and else weighs as if it erred in a millionth of the weight, and before a tree
    that is no better than chance, but for the first.
    """
    known = df.where(F.col(label).isNotNull()).withColumn("__y", F.col(label).cast("double"))
    top, n = known.agg(F.max("__y"), F.count("*")).first()
    if not n:
        raise ValueError("no labelled rows")
    prepare = assemble(cols, FEATURES).fit(known)
    classes = max(2, int(top) + 1)
    state = prepare.transform(known).select(FEATURES, "__y", F.lit(1.0).alias(WEIGHT))
    trees, alphas, errors = [], [], []
    for done in range(rounds):
        if done % WRITE_EVERY == 0:
            state = checkpointed(state, "adaboost")
        tree = DecisionTreeClassifier(
            featuresCol=FEATURES, labelCol="__y", weightCol=WEIGHT, predictionCol="__guess", rawPredictionCol="__raw", probabilityCol="__p", maxDepth=depth, seed=SEED
        ).fit(state)
        guessed = tree.transform(state).drop("__raw", "__p")
        wrong = F.col("__guess") != F.col("__y")
        missed, total = guessed.agg(F.sum(F.when(wrong, F.col(WEIGHT)).otherwise(0.0)), F.sum(WEIGHT)).first()
        err = missed / total
        if err >= 1 - 1 / classes and trees:
            break
        bounded = min(max(err, 1e-6), 1 - 1e-6)
        alpha = rate * (math.log((1 - bounded) / bounded) + math.log(classes - 1))
        trees.append(tree)
        alphas.append(alpha)
        errors.append(err)
        if err <= 0 or err >= 1 - 1 / classes:
            break
        # Weights are kept at a mean of about one, whatever the number of rounds.
        scale = n / (total + missed * (math.exp(alpha) - 1))
        state = guessed.withColumn(WEIGHT, F.col(WEIGHT) * F.when(wrong, math.exp(alpha)).otherwise(1.0) * scale).drop("__guess")
    return Vote(prepare, classes, tuple(trees), tuple(alphas), tuple(errors))


def predict_adaboost(vote: Vote, df: DataFrame, name: str = "prediction") -> DataFrame:
    """``df`` with the label that gets the largest vote, the smallest among equals; a column of that name is replaced."""
    own = [c for c in df.columns if c != name]
    out = vote.prepare.transform(df.select(*own)).select(*own, FEATURES)
    votes: list[list[Column]] = [[] for _ in range(vote.classes)]
    guesses = []
    for i, (tree, alpha) in enumerate(zip(vote.trees, vote.alphas)):
        guess = f"__guess{i}"
        out = tree.copy({tree.predictionCol: guess}).transform(out).drop("__raw", "__p")
        guesses.append(guess)
        for k in range(vote.classes):
            votes[k].append(F.when(F.col(guess) == k, alpha).otherwise(0.0))
    sums = F.array(*[sum(parts, F.lit(0.0)) for parts in votes])
    return out.withColumn("__votes", sums).select(*own, (F.array_position("__votes", F.array_max("__votes")) - 1).cast("int").alias(name))
