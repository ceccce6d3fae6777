"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.session import checkpointed

#: What the contracts call a word, and the letters that lower-casing touches.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Null as empty, A-Z as a-z, everything else unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cut batches so that Python never holds more than ``rows`` decoded texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def pack(numbers: np.ndarray) -> bytes:
    """Gaps between ascending numbers from 0 on, a byte each; 255 stands for 255 more and no number yet."""
    gaps = np.diff(numbers, prepend=-1) - 1
    more = gaps // 255
    out = np.full(int((more + 1).sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8)
    ends = steps != 255
    return np.cumsum(steps, dtype=np.int64)[ends] + np.arange(int(ends.sum()))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (a, b)``; root is the smallest node reachable.

    Rounds of large-star and small-star: each node points all its neighbours to the smallest one. Only minima per
    node are aggregated, so that a hub of any degree is combined before the shuffle and split by the skew join.
    Every half round is written to the shared folder. Self loops and nulls are ignored.
    """
    edge = checkpointed(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    state = None
    while True:
        both = edge.select("u", "v").unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = checkpointed(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
