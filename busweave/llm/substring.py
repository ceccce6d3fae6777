"""Removal of word windows that a document with a smaller id already has, behind a count-min prefilter.

First pass: every partition counts its windows in a count-min sketch; the partitions' sketches are merged by adding
cell by cell. A cell never holds less than the number of windows that fall into it, so that a window whose smallest
cell is below two occurs once. Second pass: only the other windows are grouped, exactly, by 96 bits of hash. The
sketch loses no repeat; one that is too full only sends more windows on to the exact grouping. Its counts also tell
common windows apart: those are combined before the shuffle, all others have a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busweave.llm.common import pack, small_batches, unpack
from busweave.session import checkpointed


WIDTH = 13
#: Rows of the sketch; cells per window and most cells of a row, as powers of two; cells per slice that is merged alone.
DEPTH, ROOM, MOST_CELLS, SLICE = 2, 1, 29, 20
#: A window that may occur this often is common; what is common is kept per 2^COARSE cells of the first row.
COMMON, COARSE, SALTS = 8000, 6, 64
#: Windows that a partition counts before it gives its sketch away and starts a new one.
SKETCH_WINDOWS = 4_000_000


class Codes(dict):
    """Numbers of words; ``lanes`` holds the 128-bit hash of each number. Forgets everything beyond a bound, so that
    numbers hold within one text only; what leaves are hashes."""

    def __init__(self, bound: int = 250_000):
        super().__init__()
        self.bound, self.lanes = bound, np.zeros((2, 1 << 12), np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number == self.lanes.shape[1]:
            self.lanes = np.concatenate([self.lanes, np.zeros_like(self.lanes)], axis=1)
        self.lanes[:, number] = divmod(xxhash.xxh3_128_intdigest(word), 1 << 64)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.lanes[:, numbers]


class Windows:
    """128-bit hashes of all windows of a batch of texts, from remembered word hashes."""

    def __init__(self, width: int = WIDTH):
        rule = [xxhash.xxh64_intdigest(f"window{k}".encode()) | 1 for k in range(2 * width)]
        self.width, self.codes = width, Codes()
        self.factors = np.array(rule, np.uint64).reshape(2, width)

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both halves of the hash, the text's number in the batch and the window's first word, for every window."""
        lanes = [self.codes.of(split_words(t.as_py())) for t in texts]
        sizes = np.array([c.shape[1] for c in lanes], np.int64)
        firsts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(int(sizes.sum())) - firsts
        inside = np.flatnonzero(at <= np.repeat(sizes, sizes) - self.width)
        columns = np.concatenate([*lanes, np.zeros((2, self.width), np.uint64)], axis=1)
        out = []
        for lane, column in enumerate(columns):
            h = np.zeros(len(at), np.uint64)
            for k in range(self.width):
                h += column[k : k + len(at)] * self.factors[lane, k]
            h = h[inside]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            out.append(h ^ (h >> np.uint64(29)))
        return out[0], out[1], np.repeat(np.arange(len(sizes)), sizes)[inside], at[inside].astype(np.int32)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at exactly the blanks of WORD


def cells_of(h1: np.ndarray, h2: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(64 - bits)).astype(np.int64) for h in (h1, h2)]


def sketches(texts: DataFrame, bits: int, width: int) -> DataFrame:
    """``(lane, slice, once, more, counts)``: per partition and slice of a sketch row, the cells with one count, and
    those with more and their counts."""
    names = ["lane", "slice", "once", "more", "counts"]

    def blobs(lane: int, cells: list[np.ndarray]) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
        cell, count = np.unique(np.concatenate(cells), return_counts=True)
        part = cell >> SLICE
        edges = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(cell)]):
            local, many = cell[a:b].astype(np.int64) & ((1 << SLICE) - 1), count[a:b] > 1
            yield lane, int(part[a]), pack(local[~many]), pack(local[many]), count[a:b][many].astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, n = Windows(width), [[] for _ in range(DEPTH)], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lane in range(DEPTH):
                rows = list(zip(*blobs(lane, held[lane])))
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)
                held[lane].clear()

        for batch in small_batches(batches):
            h1, h2, _, _ = windows.hashes(batch.column(0))
            for lane, cells in enumerate(cells_of(h1, h2, bits)):
                held[lane].append(cells.astype(np.uint32))
            n += len(h1)
            if n >= SKETCH_WINDOWS:
                yield from flush()
                n = 0
        if n:
            yield from flush()

    return texts.mapInArrow(run, "lane int, slice int, once binary, more binary, counts binary")


def merged_sketch(texts: DataFrame, bits: int, width: int) -> DataFrame:
    """``(lane, slice, repeated, common)``: bits of the cells whose merged count is two or more, and of the coarse
    cells that hold one of ``COMMON`` or more."""
    names = ["lane", "slice", "repeated", "common"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SLICE, np.int64)
        at = None

        def done() -> pa.RecordBatch:
            coarse = seen.reshape(-1, 1 << COARSE).max(axis=1) >= COMMON
            maps = [np.packbits(x, bitorder="little").tobytes() for x in (seen > 1, coarse)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *(pa.array([m]) for m in maps)], names)

        for batch in small_batches(batches, 64):
            for *key, once, more, counts in zip(*(column.to_pylist() for column in batch.columns)):
                if at != key:
                    if at is not None:
                        yield done()
                    at = key
                    seen[:] = 0
                seen[unpack(once)] += 1
                seen[unpack(more)] += np.frombuffer(counts, "<u4")
        if at is not None:
            yield done()

    parts = sketches(texts, bits, width).repartition("lane", "slice").sortWithinPartitions("lane", "slice")
    return parts.mapInArrow(add, "lane int, slice int, repeated binary, common binary")


def bit_at(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1


def repeated_candidates(docs: DataFrame, sketch: Broadcast, bits: int, width: int) -> DataFrame:
    """``(h1, h2, id, text_key, at, common)`` of every window that the sketch doesn't rule out."""
    names = ["h1", "h2", "id", "text_key", "at", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, (rows, common) = Windows(width), sketch.value
        for batch in small_batches(batches):
            h1, h2, owner, at = windows.hashes(batch.column("text"))
            cells = cells_of(h1, h2, bits)
            keep = np.flatnonzero(bit_at(rows[0], cells[0]) & bit_at(rows[1], cells[1]))
            who = pa.array(owner[keep])
            columns = [pa.array(h1[keep].view(np.int64)), pa.array((h2[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column("id").take(who)]
            columns += [batch.column("text_key").take(who), pa.array(at[keep]), pa.array(bit_at(common, cells[0][keep] >> COARSE))]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"h1 long, h2 int, id {kind}, text_key int, at int, common boolean")


def broadcast_sketch(docs: DataFrame, width: int) -> tuple[Broadcast, int]:
    """The merged sketch as bitmaps, at most ``DEPTH`` times 2^MOST_CELLS bits, and the bits of a cell's number."""
    room = (docs.select(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    bits = min(MOST_CELLS, max(SLICE, int(room).bit_length() + ROOM))
    rows = np.zeros((DEPTH, 1 << (bits - 3)), np.uint8)
    common = np.zeros(1 << (bits - 3 - COARSE), np.uint8)
    for r in merged_sketch(docs.select("text"), bits, width).toLocalIterator():
        rows[r.lane, r.slice << (SLICE - 3) : (r.slice + 1) << (SLICE - 3)] = np.frombuffer(r.repeated, np.uint8)
        if r.lane == 0:
            at = SLICE - 3 - COARSE
            common[r.slice << at : (r.slice + 1) << at] = np.frombuffer(r.common, np.uint8)
    return docs.sparkSession.sparkContext.broadcast((rows, common)), bits


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(id, text_key, ats)``: per text the first words of its windows that start in a row with a smaller id too.

    Candidates are shuffled once, and the smallest id of a window is taken where its rows meet: fewer than ``COMMON``
    of them, or, for a common window, the rows of one of ``SALTS`` parts. A row above its part's minimum repeats an
    earlier one; only the rows at the parts' minima are then compared with the window's own.
    ``text_key``, 32 bits of the text's hash, tells rows with equal ids apart.
    """
    sketch, bits = broadcast_sketch(docs, width)
    found = repeated_candidates(docs.where("id IS NOT NULL"), sketch, bits, width)
    salt = F.when(F.col("common"), F.pmod(F.hash("id", "text_key"), F.lit(SALTS))).otherwise(0)
    part = Window.partitionBy("h1", "h2", "salt")
    met = found.withColumn("salt", salt).withColumn("lowest", F.min("id").over(part)).where("common OR id > lowest")
    first = met["id"] == met["lowest"]
    met = checkpointed(met.select(*[F.when(first, F.col(c)).alias(c) for c in ("h1", "h2")], first.alias("first"), "id", "text_key", "at"), "met-windows")
    sketch.destroy()
    marks, key = ["id", "text_key", "at"], ["h1", "h2"]
    firsts = met.where("first")
    firsts = firsts.join(firsts.groupBy(*key).agg(F.min("id").alias("lowest")), key).where("id > lowest")
    later = met.where("NOT first").select(marks).unionByName(firsts.select(marks))
    return later.groupBy("id", "text_key").agg(F.collect_set("at").alias("ats"))


def covered(n_words: int, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which words the windows at ``starts`` cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n_words), -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words left, joined by one space).

    A null text counts as empty. Rows with a null id neither lose words nor make others lose any. Rows with equal ids
    don't take from each other, but each loses what a smaller id has. Texts below ``width`` words lose nothing.
    """
    keyed = docs.withColumn("__key", F.hash(text_col))
    slim = keyed.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col("__key").alias("text_key"))
    marks = repeats(slim, width).select(F.col("id").alias("__id"), F.col("text_key").alias("__tk"), F.col("ats").alias("__ats"))
    joined = keyed.join(marks, (F.col(id_col) == F.col("__id")) & (F.col("__key") == F.col("__tk")), "left").drop("__id", "__tk", "__key")
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    joined = joined.select(*[F.col(f"`{c}`") for c in own], "__ats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts, removed, texts = [], [], []
            for text, ats in zip(batch.column(own.index(text_col)), batch.column(len(own))):
                words = split_words(text.as_py())
                gone = covered(len(words), np.array(ats.as_py() or [], np.int64), width)
                counts.append(len(words))
                removed.append(int(gone.sum()))
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*own, "n_words", "n_removed", "kept_text"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return joined.mapInArrow(run, f"{kinds}, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
