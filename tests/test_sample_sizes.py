"""Sizes of resamples, by counting draws per key once."""

import re

from pyspark.sql import functions as F

from busweave.operators.learning import bootstrap, sample_sizes


def test_sizes_are_those_of_the_samples(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 50 > 0, (F.col("id") % 1700).cast("string")).alias("k"))
    samples = bootstrap(rows, "k", [1, 2, 3])
    want = samples.groupBy("sample").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("k").alias("distinct_rows"))
    sizes = sample_sizes(samples, "k", [1, 2, 3])
    assert sorted(map(tuple, sizes.select("sample", "rows", "distinct_rows").collect())) == sorted(map(tuple, want.collect()))
    # Keys are shuffled without their sample, so one row of a key leaves a task whatever the number of samples.
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(k#\d+, \d+\)", plan)) == 1 and not re.search(r"hashpartitioning\(sample#\d+, k#", plan)
