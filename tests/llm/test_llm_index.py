"""Exact deduplication answers from its index: rows find their entry through cell, bucket and chain."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from busweave.llm import exact  # noqa: E402


def test_rows_come_through_the_index(spark):
    rows = [(i, f"Text {i % 300}" if i % 7 else "HOT") for i in range(2000)] + [(5000, None), (5001, ""), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact.build_index(docs, capacity=20).cache()
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").lower(), []).append(i)
    assert index.count() == len(groups)
    assert index.select("bucket").distinct().count() > 10
    assert index.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 20
    got = exact.probe(docs, index).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[(r.text or "").lower()]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
    # What leaves the index, or lies in another bucket than its cell's, is not found.
    part = index.where(F.col("bucket") != index.agg(F.min("bucket")).first()[0])
    assert exact.probe(docs, part).count() == part.agg(F.sum("group_size")).first()[0] < len(rows)
    moved = index.withColumn("cell", F.col("cell") + (1 << 40))
    assert exact.probe(docs, moved).count() == 0
