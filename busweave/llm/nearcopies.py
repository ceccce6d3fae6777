"""Near copies by the Jaccard similarity of their shingles: min-hash bands propose pairs, exact comparison decides.

Fingerprints of 64 bits differ in some ten bits at a similarity of 0.8, too many for a scheme of bit fields. Bands of
min-hashes meet such a pair with probability 1 - (1 - 0.8^ROWS)^BANDS = 0.99997, and no pair is linked by them alone:
texts that bands connect are cut into parts of bounded size, and every pair in two parts that shares a band and is
not yet connected is compared shingle by shingle. What the fingerprints propose counts as one more band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busweave.llm.common import ascii_lower, components, small_batches
from busweave.llm.substring import Windows, split_words
from busweave.session import checkpointed

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: Largest part of a group that one task compares with one other part; shingles hashed at once.
PART, BLOCK = 256, 2048
RULE = np.array([[xxhash.xxh64_intdigest(f"{kind}{k}".encode()) | 1 for k in range(BANDS * ROWS)] for kind in ("factor", "plus")], np.uint64)


def shingle_sets(texts: pa.Array, windows: Windows) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the word shingles of each text; below the width all words are one, no word is one too."""
    h, _, owner, _ = windows.hashes(texts)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    for n, (a, b) in enumerate(zip(ends, ends[1:])):
        if a == b:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(split_words(texts[n].as_py())))], np.uint64)
        else:
            yield np.unique(h[a:b])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key per band, from ``ROWS`` min-hashes and the band's number."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(low, (shingles[at : at + BLOCK, None] * RULE[0] + RULE[1]).min(axis=0), out=low)
    rows = np.concatenate([low.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)[:, None]], axis=1)
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < threshold * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (small + large - both)


def linked(keys: list[np.ndarray], sets: list[list[np.ndarray]], same: bool, threshold: float) -> list[tuple[int, int]]:
    """Index pairs ``(left, right)`` that connect all similar pairs of two parts, or of one, that share a band."""
    n = len(sets[0])
    label, out = np.arange(n if same else n + len(sets[1])), []
    for x in range(n):
        shared = np.flatnonzero((keys[1] == keys[0][x]).any(axis=1))
        for y in shared[shared > x] if same else shared:
            at = y if same else n + y
            if label[x] != label[at] and similar(sets[0][x], sets[1][y], threshold):
                label[label == label[at]] = label[x]
                out.append((x, int(y)))
    return out


def text_key(text: Column) -> Column:
    """64-bit hash that stands for a text, A-Z as a-z."""
    return F.xxhash64(ascii_lower(text.cast("string")))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, links: DataFrame | None = None
) -> DataFrame:
    """``(id, component_id)`` per row of ``docs``.

    component_id is the smallest non-null id reachable over pairs whose sets of ``width``-word shingles (A-Z as a-z)
    have a Jaccard similarity of at least ``threshold``. Texts of equal shingles, and all without words, are linked.
    Rows with a null id take part; repeated rows are returned as often as they occur. Equal means 64 bits of hash.
    ``links (text_key, component_id)`` proposes what another method found: texts of one component are compared too; of
    the texts with one set of shingles the one with the smallest key stands for all.
    """
    source = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col).cast("string")).alias("text"))
    source = source.withColumn("text_key", text_key(F.col("text")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width)
        for batch in small_batches(batches, 64):
            sets = list(shingle_sets(batch.column(1), windows))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), keys], ["id", "text_key", "node", "keys"])

    kind = source.schema["id"].dataType.simpleString()
    signed = checkpointed(source.mapInArrow(sign, f"id {kind}, text_key long, node long, keys array<long>"), "band-keys")
    nodes = checkpointed(signed.groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("text_key", "keys")).alias("s")), "near-nodes")
    nodes, per_node = nodes.select("node", "low", "s.text_key", "s.keys"), BANDS
    if links is not None:
        proposed = nodes.select("node", "text_key").join(links, "text_key").select("node", F.col("component_id").alias("more"))
        more = F.array(F.coalesce("more", "node"))  # a key of its own where nothing is proposed
        nodes = nodes.join(proposed, "node", "left").withColumn("keys", F.concat("keys", more)).drop("more")
        nodes, per_node = checkpointed(nodes, "near-proposed"), BANDS + 1
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = components(keyed.join(met, "key").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    met = checkpointed(met.unionByName(met.select(F.col("root").alias("node"), "root")).distinct(), "near-candidates")  # a root names itself

    parts = met.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    wanted = met.join(parts, "root").join(nodes.select("node", "text_key", "keys"), "node")
    texts = source.select("text_key", "text").join(wanted.select("text_key"), "text_key", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    placed = wanted.join(texts, "text_key").select("text", "node", "keys", "root", "parts")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width)
        for batch in small_batches(batches, 64):
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(0), windows)], pa.binary())
            yield pa.RecordBatch.from_arrays([sets, *batch.columns[1:]], ["shingles", *batch.schema.names[1:]])

    placed = placed.mapInArrow(sets_of, "shingles binary, node long, keys array<long>, root long, parts int")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    units = placed.withColumn("other", other).groupBy("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    gathered = units.agg(F.collect_list(F.struct("part", "node", "keys", "shingles")).alias("members")).select("i", "j", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            i, j, members = (column[0].as_py() for column in batch.columns)
            sides = [[m for m in members if m["part"] == p] for p in (i, j)]
            keys = [np.array([m["keys"] for m in side], np.int64).reshape(-1, per_node) for side in sides]
            sets = [[np.frombuffer(m["shingles"], np.uint64) for m in side] for side in sides]
            pairs = linked(keys, sets, i == j, threshold)
            ends = [[sides[s][pair[s]]["node"] for pair in pairs] for s in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

    roots = components(gathered.mapInArrow(run, "a long, b long").distinct())
    rooted = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return signed.select("id", "node").join(rooted.join(lowest, "root").select("node", "component_id"), "node").select("id", "component_id")
