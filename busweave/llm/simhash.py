"""Near-duplicate detection on SimHash fingerprints with pivot distance tables.

Every fingerprint is measured against fixed reference fingerprints. The Hamming distance obeys the triangle
inequality, so that a pair whose distances to any reference differ by more than the radius is discarded without
being compared; only survivors are verified bit by bit. 64-bit distances crowd around 32, so the tables alone
would leave most pairs of a large corpus together in one task. They are therefore kept per group of fingerprints
that agree on two of five bit fields, which every pair within radius 3 does in at least one of ten ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busweave.llm.common import components, small_batches
from busweave.session import checkpointed

RADIUS = 3
#: Reference fingerprints, by rule: XXH64 of the bytes "0", "1", ...
PIVOTS = tuple(xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(16))
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Largest part of a group that one task compares with one other part.
PART = 1024
BLOCK = 16_384


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = max(1, len(words) - width + 1)
    ends = (starts + sizes)[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    begins = starts[:n].tolist()
    for at in range(0, n, BLOCK):
        h = [digest(line[a:b], 42) for a, b in zip(begins[at : at + BLOCK], ends[at : at + BLOCK])]
        bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; fp is the fingerprint as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [signed(fingerprint(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def close_pairs(fp: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius``: candidates by the first reference in sorted order, then every other reference."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int64)
    stop = np.searchsorted(first, first + radius, side="right")
    at = np.arange(len(fp))
    many = stop - at - 1
    left = np.repeat(at, many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + left + 1
    left, right = order[left], order[right]
    for k in range(1, table.shape[1]):
        near = np.abs(table[left, k] - table[right, k]) <= radius
        left, right = left[near], right[near]
    near = np.bitwise_count(fp[left] ^ fp[right]) <= radius
    return left[near], right[near]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per connected part: (root, member) index pairs, at most ``n - 1`` of them."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        low = low[low]
        if (low == label).all():
            break
        label = low
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints ``distinct.fp`` linked within the radius.

    Groups of equal keys are counted before they are gathered. A group beyond ``PART`` members is cut into parts by
    hash and every pair of parts is a unit of its own, so that no task holds more than two parts, and each unit
    returns a spanning forest instead of its pairs.
    """
    masks = [sum(((1 << w) - 1) << s for s, w in pair) for pair in combinations(FIELDS, 2)]
    pivots = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("byte") for p in PIVOTS])
    keyed = distinct.select(
        "fp",
        pivots.alias("pivots"),
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("way", "key"),
    )
    groups = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = keyed.join(groups, ["way", "key"]).withColumn("parts", parts).withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    units = placed.withColumn("other", other).groupBy(
        "way", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )
    gathered = units.agg(F.collect_list("fp").alias("fps"), F.flatten(F.collect_list("pivots")).alias("pivots")).select("fps", "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps, pivots in zip(batch.column(0), batch.column(1)):
                fp = fps.values.to_numpy(zero_copy_only=False)
                table = pivots.values.to_numpy(zero_copy_only=False).astype(np.int16).reshape(len(fp), -1)
                root, member = forest(len(fp), *close_pairs(fp.view(np.uint64), table))
                a.append(fp[root])
                b.append(fp[member])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.array([], np.int64)])) for x in (a, b)], ["a", "b"])

    return gathered.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` per row of ``docs``.

    component_id is the smallest non-null id reachable over links of at most three differing bits, itself included.
    Texts without words have fingerprint zero and are linked like any other. Rows with a null id take part and get
    their component's id, null if no row of it has one. Repeated rows are returned as often as they occur; other
    columns are not looked at. An empty table gives an empty result.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")
