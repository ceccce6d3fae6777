"""Exact top-k search by inner product over a vector-approximation file.

Components are turned into integers. The file holds one byte per component, the cell of width ``CELL`` that the
component lies in, and the length of what the cells leave over. Scanning it bounds every score: the product with the
cells' centres, give or take the product of the lengths of the query and of the rest. Exact vectors are then read in
the order of their upper bounds until no unread vector can reach the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busweave.session import checkpointed

SCALE, CELL = 256, 4
#: Distinct queries and vectors that one task compares at a time.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 4096


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the rows with an id and a vector of finite components; v is an array of longs."""
    x = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, finite))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return usable.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def va_file(classes: DataFrame) -> DataFrame:
    """``(cid, cells, rest)`` of ``classes (cid, v)``: clamped cells as bytes, and the length of v minus the centres."""
    cell = F.transform("v", lambda c: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(c / CELL))).cast("byte"))
    centred = classes.withColumn("cells", cell)
    off = F.zip_with("v", "cells", lambda c, b: (c - b.cast("long") * CELL).cast("double") - (CELL - 1) / 2)
    rest = F.sqrt(F.aggregate(off, F.lit(0.0), lambda acc, d: acc + d * d))
    return centred.select("cid", "cells", rest.alias("rest"))


def scan(k: int):
    """Per block of queries and block of the file: the pairs whose upper bound reaches the k-th best lower bound."""

    def run(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": [], "cid": [], "lower": [], "upper": []})
        if queries.empty or cells.empty:
            return none
        dims = max(max(map(len, queries["v"])), max(map(len, cells["cells"])))
        q, c = np.zeros((len(queries), dims)), np.zeros((len(cells), dims))
        for i, v in enumerate(queries["v"]):
            q[i, : len(v)] = v
        for i, v in enumerate(cells["cells"]):
            c[i, : len(v)] = np.asarray(v, float) * CELL + (CELL - 1) / 2
        middle = q @ c.T
        slack = np.outer(np.linalg.norm(q, axis=1), cells["rest"].to_numpy() + 1e-6) * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1e-6
        lower, upper = middle - slack, middle + slack
        bar = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(q), -np.inf)
        i, j = np.nonzero(upper >= bar[:, None])
        return pd.DataFrame({"qid": queries["qid"].to_numpy()[i], "cid": cells["cid"].to_numpy()[j], "lower": lower[i, j], "upper": upper[i, j]})

    return run


def blocks(column: str, count: int, size: int):
    return F.pmod(F.xxhash64(column), F.lit(max(1, -(-count // size)))).cast("int")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: per row of ``queries``, whose ids are ids of ``vectors``, its k best others.

    Ties go to the smaller id. Rows with a null id, a null vector or a null or non-finite component take no part.
    Shorter vectors count as padded with zeros. Equal vectors are compared once: a class keeps its k + 1 smallest
    ids, which is all that a result can need. A vector that a third of all rows share is cut to that many before and
    after the shuffle. Repeated rows count as one. Scores are exact for components below 2^21 in size.
    """
    best = k + 1  # the query's own class may take one place
    rows = quantised(vectors, id_col, vector_col).distinct()
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.withColumn("nth", nth).where(F.col("nth") <= best).groupBy("v").agg(F.collect_list("id").alias("ids"))
    classes = checkpointed(classes.select(F.array_min("ids").alias("cid"), "v", "ids"), "vectors")
    asked = quantised(queries, id_col, vector_col).distinct().join(classes.select("cid", "v"), "v")
    asked = checkpointed(asked.select("id", "cid", "v"), "queries")
    distinct = asked.groupBy(F.col("cid").alias("qid")).agg(F.first("v").alias("v"))
    n_queries, n_vectors = distinct.count(), classes.count()
    q_blocks, v_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_vectors // VECTOR_BLOCK))
    approximations = checkpointed(va_file(classes), "va-file")
    left = distinct.withColumn("qb", blocks("qid", n_queries, QUERY_BLOCK)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    right = approximations.withColumn("vb", blocks("cid", n_vectors, VECTOR_BLOCK)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    bounds = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(scan(best), "qid long, cid long, lower double, upper double")
    bounds = checkpointed(bounds, "bounds")
    kth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lower")))
    bar = bounds.withColumn("nth", kth).where(F.col("nth") == best).select("qid", F.col("lower").alias("bar"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("upper"), "cid"))
    open_ = bounds.join(bar, "qid", "left").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar")))
    open_ = checkpointed(open_.select("qid", "cid", "upper").withColumn("turn", order), "open")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda acc, p: acc + p)

    def read(pairs: DataFrame) -> DataFrame:
        exact = pairs.join(classes, "cid").join(distinct.select("qid", F.col("v").alias("q")), "qid")
        return exact.select("qid", "cid", "ids", product.alias("score"))

    first, known = 4 * best, None
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"))
    while not open_.isEmpty():
        scored = read(open_.where(F.col("turn") <= first))
        scored = scored if known is None else scored.unionByName(known)
        known = checkpointed(scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= best).drop("place"), "scored")
        nth = F.row_number().over(by_score)
        certain = known.withColumn("nth", nth).where(F.col("nth") == best).select("qid", F.col("score").alias("kth"))
        rest = open_.where(F.col("turn") > first).join(certain, "qid", "left")
        open_ = checkpointed(rest.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("qid", "cid", "upper", "turn"), "open")
        first *= 8
    if known is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    spread = known.select("qid", "score", F.explode("ids").alias("other"))
    results = asked.select(F.col("id").alias("query_id"), F.col("cid").alias("qid")).join(spread, "qid").where("other != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "other"))
    return results.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("other").alias("id"), "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0")).withColumnRenamed("id", "vec_id")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
