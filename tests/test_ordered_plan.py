"""Shuffles of the slice operator, and null keys of several types."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from busweave.operators.ordered import following, over_slices, position, running_sum


def exchanges_over(plan, column):
    """Shuffles that rows with ``column`` pass on their way to the result."""
    own = int(plan.nodeName().startswith("Exchange") and column in plan.output().mkString(","))
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return own + max((exchanges_over(x, column) for x in below), default=0)


@pytest.fixture
def plain(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [["a"], ["a", "b"], ["d", "a", "b"]])
def test_wide_rows_are_shuffled_once(spark, plain, keys):
    df = spark.createDataFrame([(1, "x", dt.date(2024, 1, 1), 5, "payload")], "a long, b string, d date, at long, payload string")
    out = over_slices(df, keys, ["at"], F.floor(F.col("at") / 10), nxt=following("at"), pos=position(), run=running_sum(F.col("at")))
    plan = out._jdf.queryExecution().executedPlan()
    assert "SortMergeJoin" in plan.toString()
    assert exchanges_over(plan, "payload") == 1


@pytest.mark.parametrize(
    "kind,some",
    [("string", ["", "x"]), ("int", [0, 7]), ("double", [0.0, 2.5]), ("decimal(9,2)", [0, 1]), ("boolean", [False, True]), ("date", [dt.date(1970, 1, 1), dt.date(2024, 1, 1)]),
     ("timestamp", [dt.datetime(1970, 1, 1), dt.datetime(2024, 1, 1)]), ("array<int>", [[0], [1]])],
)
def test_null_is_a_key_of_its_own(spark, kind, some):
    """Rows of the null key stay apart from those of the value that fills it, across slices."""
    rows = [(some[i % 3] if i % 3 < 2 else None, i % 2 if i % 5 else None, i) for i in range(60)]
    df = spark.createDataFrame([(i, b, at) for at, (_, b, i) in enumerate(rows)], "i int, b int, at int").withColumn("i", F.col("at"))
    typed = F.array(*[F.lit(v).cast(kind) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]) for v in some])
    df = df.withColumn("k", F.when(F.col("at") % 3 < 2, F.get(typed, F.col("at") % 3)))
    out = over_slices(df, ["k", "b"], ["at"], F.floor(F.col("at") / 7), pos=position(), nxt=following("at"))
    got = {r.at: (r.pos, r.nxt.at if r.nxt else None) for r in out.collect()}
    pdf = pd.DataFrame([(at % 3, b if b is not None else -1, at) for at, (_, b, _) in enumerate(rows)], columns=["k", "b", "at"])
    groups = pdf.groupby(["k", "b"])["at"]
    want = {at: (p + 1, None if pd.isna(n) else int(n)) for at, p, n in zip(pdf["at"], groups.cumcount(), groups.shift(-1))}
    assert got == want
    assert dict(out.dtypes)["k"] == dict(df.dtypes)["k"]
