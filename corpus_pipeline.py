"""Five stages that turn ``documents`` into a mixed, encoded training corpus.

Toxic documents are rejected, of equal texts and of each group of near duplicates one document stays, the sources are
mixed to their target weights, and what the mix takes is encoded. All but the last stage return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busweave.llm import bpe, exact, mixing, nearcopies, simhash, toxicity
from busweave.session import checkpointed

REJECT_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled documents of the training folds, keep what scores below ``REJECT_FROM``."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = toxicity.fit(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, weights).where(F.col("toxicity") < REJECT_FROM).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.deduplicate(docs).where("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; rows without an id stay too.

    Operator (1) proposes texts whose fingerprints differ in three bits at most, min-hash bands those that differ in
    more; proposed texts are near copies if their five-word shingles have a similarity of 0.8 or more.
    """
    texts = docs.select(nearcopies.text_key(F.col("text")).alias("text_key"), "text")
    links = simhash.near_duplicates(texts, "text_key").select(F.col("id").alias("text_key"), "component_id").distinct()
    groups = nearcopies.near_copies(docs, links=links).where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(groups, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document that the mix takes, with the words it takes."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to.

    The ids are written before they are decoded: in one stage both steps would hold a Python worker for each core.
    """
    return bpe.decode(checkpointed(bpe.encode(docs), "ids")).select(
        "doc_id",
        "lang",
        "source",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's rows are written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Scores and block draws are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None
