"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busweave.llm.common import pack, small_batches, unpack
from busweave.session import checkpointed

BITS = 18
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}']+")
#: Multipliers that mix two word hashes to a bigram or, by gap, a skip-gram: odd, by rule.
MIX = [xxhash.xxh64_intdigest(f"gap{g}".encode()) | 1 for g in range(4)]


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 100_000):
        self.seen, self.bound = {}, bound

    def hashes(self, text: str) -> np.ndarray:
        if len(self.seen) > self.bound:
            self.seen.clear()
        seen, out = self.seen, []
        for word in TOKEN.findall(text.lower()):
            h = seen.get(word)
            if h is None:
                h = seen[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
            out.append(h)
        return np.array(out, np.uint64)


def features(text: str | None, words: Words) -> np.ndarray:
    """Distinct coordinates of the text's words, bigrams and skip-grams over one and two words."""
    h = words.hashes(text or "")
    parts = [h]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * np.uint64(MIX[gap]) + h[gap:]) * np.uint64(MIX[0]))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate learning rates (alpha, beta) and L1, L2 strengths; coordinate 2^BITS is the bias."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.0

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, z: np.ndarray, n: np.ndarray, examples: Iterable[tuple[np.ndarray, int]]) -> None:
        """One pass over ``(coordinates, label)``, changing z and n in place."""
        for at, label in examples:
            w = self.weights(z[at], n[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha
            z[at] += g - sigma * w
            n[at] += g * g


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``(id, text, y)``: at most ``max_rows`` labelled rows outside the held-out fold, by smallest hash of the id.

    The chosen ids, ``max_rows`` at most, are broadcast, so that no text is shuffled to find them.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "text", "y")


def one_pass(state: Broadcast, rule: Ftrl, epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def learn(part: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in state.value)
        part = part.sort_values("id")
        packed, y = part["at"].to_numpy(), part["y"].to_numpy()
        order = np.random.default_rng(epoch).permutation(len(part))
        # Coordinates take eight times their packed bytes: only those of one row are unpacked at a time.
        rule.learn(z, n, ((unpack(packed[i]), int(y[i])) for i in order))
        at = np.flatnonzero(n)
        return pd.DataFrame({"at": at, "z": z[at], "n": n[at]})

    return learn


def average(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Mean state of a slice of the coordinates, packed into one row."""

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        total = part.groupby("at")[["z", "n"]].sum() / shards
        columns = {"at": total.index.to_numpy(np.int32), "z": total["z"].to_numpy(), "n": total["n"].to_numpy()}
        return pd.DataFrame({name: [values.tobytes()] for name, values in columns.items()})

    return mean


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 16_000, shard_rows: int = 8_000, epochs: int = 4, rule: Ftrl = Ftrl()) -> np.ndarray:
    """Weights of length 2^BITS + 1, most of them zero.

    Training reads at most ``max_rows`` labelled rows. Their coordinates are written once, as gaps of
    a byte or so each. Every epoch, tasks of
    about ``shard_rows`` rows go on from the shared state, and their states are averaged per coordinate; the state
    has a fixed size, 2^BITS + 1 pairs of numbers. Without labelled rows all weights are zero.
    """
    spark = docs.sparkSession
    sample = training_rows(docs, labels, label, max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in small_batches(batches):
            rows = [pack(np.append(features(t.as_py(), words), np.int32(1 << BITS))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "y", "at"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = checkpointed(sample.mapInArrow(extract, f"id {kind}, y int, at binary"), "training")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for epoch in range(epochs):
        state = spark.sparkContext.broadcast((z, n))
        moved = rows.groupBy("shard").applyInPandas(one_pass(state, rule, epoch), "at long, z double, n double")
        slices = moved.groupBy(F.shiftright("at", 12)).applyInPandas(average(shards), "at binary, z binary, n binary").collect()
        z, n = np.zeros_like(z), np.zeros_like(n)
        for part in slices:
            at = np.frombuffer(part["at"], np.int32)
            z[at], n[at] = np.frombuffer(part["z"]), np.frombuffer(part["n"])
        state.unpersist()
    return rule.weights(z, n)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1). Null and empty texts get the score of the bias alone."""
    at = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = Words(), np.zeros((1 << BITS) + 1)
        w[model.value[0]] = model.value[1]
        text_at = None
        for batch in small_batches(batches):
            if text_at is None:
                text_at = batch.schema.get_field_index(text_col)
            sums = [w[features(t.as_py(), words)].sum() + w[-1] for t in batch.column(text_at)]
            value = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "toxicity"])

    kept = docs.drop("toxicity")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", toxicity double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, weights)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
