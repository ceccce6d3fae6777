"""Exact deduplication over an extendible-hash index kept in shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busweave.llm.common import ascii_lower
from busweave.session import checkpointed, scratch_dir

#: Most doublings beyond those that an even spread needs; a bucket still overfull then keeps an overflow chain.
EXTRA_DEPTH = 6


def top_bits(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory ``(cell, bucket)`` over the top bits of ``keys.h`` and its global depth.

    Starts at the depth that an even spread needs. While a bucket holds more than ``capacity`` distinct hashes the
    directory doubles and that bucket splits; the others are shared by both halves of the doubled directory. A
    bucket of a single hash cannot split: its texts form a chain. The result has a few rows per bucket, and only
    the counts that say how often to double reach the driver.
    """
    n = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, n / capacity))))
    last = depth + EXTRA_DEPTH
    open_, settled = keys.select("h"), []
    while True:
        filled = open_.groupBy(top_bits(F.col("h"), depth).alias("cell")).agg(
            F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("chain")
        )
        filled = checkpointed(filled.withColumn("full", (F.col("n") > capacity) & ~F.col("chain") & F.lit(depth < last)), "directory")
        settled.append((depth, filled.where("not full").select("cell")))
        overfull = filled.where("full").select("cell")
        if overfull.isEmpty():
            break
        open_ = open_.withColumn("cell", top_bits(F.col("h"), depth)).join(overfull, "cell", "left_semi").select("h")
        depth += 1
    cells = None
    for at, part in settled:
        low = F.shiftleft(F.col("cell"), depth - at)
        spread = part.select(
            F.explode(F.sequence(low, low + F.lit((1 << (depth - at)) - 1))).alias("cell"),
            F.concat_ws("/", F.lit(at), F.col("cell")).alias("bucket"),
        )
        cells = spread if cells is None else cells.unionByName(spread)
    return cells, depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000) -> DataFrame:
    """Index of the distinct texts of ``docs``, read back from its files in the shared folder.

    The directory is built over the distinct hashes. Every row is then routed to its directory cell and bucket, and
    within the bucket rows are combined by hash and by the bytes of the text, before and after the shuffle, so that a text with a
    third of all rows costs one row per task. Texts whose hashes collide get chain numbers 0, 1, ... in their bucket.
    Each owner task writes the buckets of one range of cells to its own file.
    """
    body = ascii_lower(F.col(text_col))
    keys = checkpointed(docs.select(F.xxhash64(body).alias("h")).distinct(), "hashes")
    cells, depth = directory(keys, capacity)
    cells = checkpointed(cells, "cells")
    hashed = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("h", F.xxhash64("body"))
    routed = hashed.withColumn("cell", top_bits(F.col("h"), depth)).join(cells, "cell")
    entries = (
        routed.groupBy("bucket", "cell", "h", "body")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("bucket", "cell", "h", F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").alias("n_bytes"), "keep_id", "group_size")
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")) - 1
    # Written before the sort by ranges, which reads its input twice.
    placed = checkpointed(entries.withColumns({"chain": chain, "depth": F.lit(depth)}), "entries")
    path = scratch_dir(docs.sparkSession, "exact-index")
    placed.repartitionByRange("cell").sortWithinPartitions("cell", "h", "chain").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def probe(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 taken from ``index``; any other columns pass through.

    A row finds its cell by the leading bits of its hash, the cell's bucket in the directory, and there the entry of
    its hash and text along the chain. A text that the index does not hold is left out.

    A null text counts as empty. A row with a null id never stands for a group that has another id; among rows with
    the same text and the same id all are marked kept. An empty table gives an empty result.
    """
    body = ascii_lower(F.col(text_col))
    depth = index.agg(F.max("depth")).first()[0] or 0
    cells = index.groupBy(F.col("cell").alias("__cell")).agg(F.max("bucket").alias("__bucket"))
    found = index.select(
        F.col("bucket").alias("__in"), F.col("h").alias("__h"), F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__n")
    )
    keyed = docs.withColumn("__body", body).withColumn("__dh", F.xxhash64("__body")).withColumn("__dsha", F.sha2("__body", 256)).drop("__body")
    routed = keyed.withColumn("__cell", top_bits(F.col("__dh"), depth)).join(cells, "__cell")
    joined = routed.join(found, (F.col("__bucket") == F.col("__in")) & (F.col("__dh") == F.col("__h")) & (F.col("__dsha") == F.col("__sha")))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    return joined.select(
        *own,
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__dsha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its group; see ``probe`` for nulls, ties and repeated rows."""
    return probe(docs, build_index(docs, id_col, text_col), id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).drop("text")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
