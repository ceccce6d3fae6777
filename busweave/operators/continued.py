"""Training that goes on where an earlier model stopped.

A chain is a sum of parts on the scale of log-odds. A further fit sees only its own slice of rows; the margin that the
chain so far gives them is where it starts from, as the offset of a logistic regression or as the gradients that the
next trees are fitted to. Earlier parts never change, so that a chain after two slices holds the chain after one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Model, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.operators.learning import SEED, assemble
from busweave.session import checkpointed

FEATURES, MARGIN = "__features", "__margin"
#: Rounds of boosting between two written states of a slice's margins.
WRITE_EVERY = 5


@dataclass(frozen=True)
class Chain:
    """Prepared features, the log-odds that all rows start from, and the parts; a tree counts ``rate`` of its value."""

    prepare: PipelineModel
    start: float
    parts: tuple[tuple[Model, float | None], ...] = ()


def _add(df: DataFrame, part: Model, rate: float | None) -> DataFrame:
    """Margins after one more part: a tree adds to them, a logistic part has them as its offset."""
    if rate is None:
        return part.transform(df).drop(MARGIN, "__mean").withColumnRenamed("__link", MARGIN)
    return part.transform(df).withColumn(MARGIN, F.col(MARGIN) + rate * F.col("__value")).drop("__value")


def _prepared(chain: Chain, df: DataFrame) -> DataFrame:
    out = chain.prepare.transform(df)
    out = out.select(*df.columns, FEATURES, F.lit(chain.start).alias(MARGIN))
    for part, rate in chain.parts:
        out = _add(out, part, rate)
    return out


def _first(df: DataFrame, cols: Sequence[str], label: str) -> Chain:
    """Chain without parts: the log-odds of the slice's labels, kept finite by half a row of either class."""
    positive, n = df.agg(F.sum(F.col(label).cast("double")), F.count(label)).first()
    if not n:
        raise ValueError("no labelled rows to start from")
    return Chain(assemble(cols, FEATURES).fit(df), math.log((positive + 0.5) / (n - positive + 0.5)))


def _probability() -> Column:
    return 1 / (1 + F.exp(-F.col(MARGIN)))


def continue_boosting(
    df: DataFrame, cols: Sequence[str], label: str, earlier: Chain | None = None, rounds: int = 10, rate: float = 0.3, depth: int = 4
) -> Chain:
    """``earlier`` and ``rounds`` more trees fitted to the labelled rows of ``df``, or a new chain.

    Each tree takes a Newton step of the logistic loss: its rows weigh ``p (1 - p)`` and their target is
    ``(y - p) / (p (1 - p))``, so that a leaf holds the sum of gradients over the sum of weights. Rows without a label
    are left out; null features take the means of the chain's first slice.
    """
    known = df.where(F.col(label).isNotNull())
    chain = earlier or _first(known, cols, label)
    state = _prepared(chain, known).select(FEATURES, MARGIN, F.col(label).cast("double").alias("__y"))
    for done in range(rounds):
        if done % WRITE_EVERY == 0:
            state = checkpointed(state, "margins")
        weight = F.greatest(_probability() * (1 - _probability()), F.lit(1e-12))
        target = state.withColumn("__w", weight).withColumn("__r", (F.col("__y") - _probability()) / F.col("__w"))
        tree = DecisionTreeRegressor(featuresCol=FEATURES, labelCol="__r", weightCol="__w", predictionCol="__value", maxDepth=depth, seed=SEED)
        model = tree.fit(target)
        chain = replace(chain, parts=(*chain.parts, (model, rate)))
        state = _add(state, model, rate)
    return chain


def continue_logistic(df: DataFrame, cols: Sequence[str], label: str, earlier: Chain | None = None, regularisation: float = 0.0) -> Chain:
    """``earlier`` and one logistic regression of the labelled rows of ``df`` with the chain's margin as offset."""
    known = df.where(F.col(label).isNotNull())
    chain = earlier or _first(known, cols, label)
    state = checkpointed(_prepared(chain, known).select(FEATURES, MARGIN, F.col(label).cast("double").alias("__y")), "margins")
    model = GeneralizedLinearRegression(
        family="binomial", featuresCol=FEATURES, labelCol="__y", offsetCol=MARGIN, predictionCol="__mean", linkPredictionCol="__link", regParam=regularisation
    ).fit(state)
    return replace(chain, parts=(*chain.parts, (model, None)))


def predict_chain(chain: Chain, df: DataFrame) -> DataFrame:
    """``df`` with ``margin``, ``score`` (0 to 1) and ``prediction`` (1 from 0.5 on); columns of these names are replaced."""
    own = [c for c in df.columns if c not in ("margin", "score", "prediction")]
    scored = _prepared(chain, df.select(*own))
    return scored.select(*own, F.col(MARGIN).alias("margin"), _probability().alias("score"), (F.col(MARGIN) >= 0).cast("int").alias("prediction"))


def continue_slices(frames: Sequence[DataFrame], fit, *args, **params) -> list[Chain]:
    """The chain after each slice, every one continuing the one before."""
    chains: list[Chain] = []
    for frame in frames:
        chains.append(fit(frame, *args, earlier=chains[-1] if chains else None, **params))
    return chains
