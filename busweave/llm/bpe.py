"""Byte-level BPE encoding over overlapping chunks, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busweave.llm.common import small_batches
from busweave.session import checkpointed

#: Characters that a chunk starts after the one before, and by which it reaches into the next.
CHUNK, OVERLAP = 100_000, 2_000
#: A chunk's own end may cut a pre-token short: boundaries in its last token or this close to its end don't count.
MARGIN = 8


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equal ones before others."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if i < n else n
        if not j or j >= n or not end[j] or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts pre-token by pre-token and remembers pre-tokens up to a bound."""

    def __init__(self, path: str, pattern: str, bound: int = 400_000):
        self.ranks, self.split = load_ranks(path), regex.compile(pattern).findall
        self.seen, self.bound = {}, bound

    def encode(self, text: str) -> bytes:
        """Packed ids, little-endian unsigned 32-bit."""
        seen, ids = self.seen, []
        if len(seen) > self.bound:
            seen.clear()
        for token in self.split(text):
            found = seen.get(token)
            if found is None:
                found = merge(token.encode(), self.ranks)
                if len(token) <= 64:
                    seen[token] = found
            ids += found
        return np.array(ids, "<u4").tobytes()


def boundaries(text: str, at: int, last: bool, split: regex.Pattern) -> tuple[list[int], list[int]]:
    """Offsets of pre-token starts in a chunk that starts at ``at``: those in its first ``OVERLAP`` characters and
    those in the stretch that it shares with the next chunk."""
    starts = [m.start() for m in split.finditer(text)]
    head = [at + s for s in starts if 0 < s < OVERLAP]
    safe = min(starts[-1] if starts else 0, len(text) - MARGIN)
    tail = [] if last else [at + s for s in starts if CHUNK <= s <= safe]
    return head, tail


def long_pieces(docs: DataFrame, pattern: str) -> DataFrame:
    """Pieces ``(key, part, text)`` of ``docs (key, text)``, cut where neighbouring chunks agree on a pre-token start.

    Chunks of all documents are pre-tokenised in parallel. A pre-token depends only on what follows its start, so
    that from the first start that two overlapping chunks share on, both read the same pre-tokens. Only offsets
    inside the overlaps are shuffled. Where two chunks share none, or an earlier pair of the document didn't, no cut
    is made there: the piece runs on, whole.
    """
    size = F.char_length("text")
    chunks = docs.select("key", size.alias("size"), "text", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))).alias("part"))
    chunks = chunks.select(
        "key",
        "part",
        (F.col("size") <= (F.col("part") + 1) * CHUNK + OVERLAP).alias("last"),
        F.substring("text", F.col("part") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("text"),
    ).repartition("key", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in small_batches(batches, 64):
            found = [
                boundaries(text.as_py(), part.as_py() * CHUNK, last.as_py(), split)
                for part, last, text in zip(batch.column("part"), batch.column("last"), batch.column("text"))
            ]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), *lists], ["key", "part", "head", "tail"])

    edges = chunks.mapInArrow(run, "key string, part int, head array<long>, tail array<long>")
    order = Window.partitionBy("key").orderBy("part")
    shared = F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    cuts = edges.withColumn("cut", shared)
    cuts = cuts.withColumn("broken", F.max(F.col("cut").isNull()).over(order)).where("NOT broken")
    cuts = cuts.withColumn("until", F.lead("cut").over(order)).select("key", "part", "cut", "until")
    until = F.coalesce("until", size.cast("long"))
    piece = F.substring("text", (F.col("cut") + 1).cast("int"), (until - F.col("cut")).cast("int"))
    return docs.join(cuts, "key").select("key", "part", piece.alias("text")).repartition("key", "part")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids``: token ids packed as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids. No special tokens: their strings are ordinary text. Documents up to
    one chunk are encoded where they lie; only longer ones are cut, and their pieces' ids joined again in order.
    Every row of ``docs`` gives one row, repeated ids and repeated rows included.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    others = [c for c in docs.columns if c not in (text_col, "ids")]
    packed = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("__one")).alias("rest")
    rows = docs.select(packed, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.char_length("text") > CHUNK + OVERLAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in small_batches(batches):
            ids = pa.array([encoder.encode(t.as_py()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])

    rest = rows.schema["rest"].dataType.simpleString()
    short = rows.where(~is_long).mapInArrow(run, f"rest {rest}, ids binary")
    long = checkpointed(rows.where(is_long).select(F.expr("uuid()").alias("key"), "rest", "text"), "long-texts")
    pieces = long_pieces(long.select("key", "text"), pattern).mapInArrow(run, "key string, part int, ids binary")
    joined = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "ids")))["ids"].alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x))
    long = long.select("key", "rest").join(joined, "key").select("rest", whole.alias("ids"))
    return short.unionByName(long).select(*[F.col("rest")[c].alias(c) for c in others], "ids")


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``: the vocabulary's raw bytes of the ids in order, which need not be valid UTF-8 alone."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = encoded.drop("bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        words = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        for batch in small_batches(batches):
            at = batch.schema.get_field_index(ids_col)
            texts = [b"".join([words[i] for i in np.frombuffer(x.as_py(), "<u4").tolist()]) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "bytes"])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", bytes binary")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
