"""Token ids in binary files: one concatenated id array per file, document boundaries in Elias-Fano code.

File format, little-endian throughout:

    magic "BWTOKEF1", then 6 unsigned 64-bit numbers: documents n, ids u, low bits l, bytes of the high part,
    number of select samples, bytes per id
    ids            u x unsigned 16-bit where the vocabulary allows, else 32-bit
    low bits       n values of l bits, packed, padded to whole bytes
    high bits      bit (end_i >> l) + i is set for the i-th document's end, padded to whole bytes
    samples        unsigned 32-bit bit positions of every 256th set high bit

The boundaries take about 2 + log2(u / n) bits a document; ``select`` finds one from the nearest sample.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from busweave.llm.common import small_batches
from busweave.session import checkpointed, scratch_dir

MAGIC, HEAD, SAMPLE = b"BWTOKEF1", struct.Struct("<8s6Q"), 256
#: Bytes of text per file, about.
FILE_TEXT = 16_000_000


class EliasFano:
    """Non-decreasing numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        weights = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> weights) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = ((values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th number: walk from the sample before it to the i-th set bit, then add its low bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << k
        return (at - i) << self.low_bits | low

    def values(self) -> np.ndarray:
        """All numbers, in order."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return (at << self.low_bits) + bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def file_bytes(documents: list[bytes], dtype: str) -> bytes:
    width = np.dtype(dtype).itemsize
    ends = EliasFano.of(np.cumsum([len(x) // width for x in documents]))
    head = HEAD.pack(MAGIC, len(documents), sum(map(len, documents)) // width, ends.low_bits, len(ends.high), len(ends.samples), width)
    return b"".join([head, *documents, ends.low.tobytes(), ends.high.tobytes(), ends.samples.tobytes()])


class TokenFile:
    """A file's bytes, read without copying the id array."""

    def __init__(self, data: bytes):
        magic, n, u, bits, high, samples, width = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.ids = np.frombuffer(data, f"<u{width}", u, at)
        at += width * u
        size = -(-n * bits // 8)
        low, at = np.frombuffer(data, np.uint8, size, at), at + size
        self.ends = EliasFano(n, bits, low, np.frombuffer(data, np.uint8, high, at), np.frombuffer(data, "<u4", samples, at + high))

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class Encoder:
    """Packed ids of whole texts. The tokenizer drops white space and never joins what it separates, so that each
    distinct word between ASCII blanks is encoded once and remembered, up to a bound. New words go to the tokenizer
    together, with a sign between them that is a single id; words that hold the sign go there alone."""

    SIGNS = "\u00a7\u00ac\u00a4~|"

    def __init__(self, path: str, dtype: str, bound: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.seen, self.dtype, self.bound = Tokenizer.from_file(path), {}, dtype, bound
        ids = {sign: self.ids([sign])[0] for sign in self.SIGNS}
        self.sign = next((sign for sign in self.SIGNS if len(ids[sign]) == 1), None)
        self.sign_id = ids[self.sign][0] if self.sign else None

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [got.ids for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        sign = self.sign.encode() if self.sign else b""
        plain = [w for w in words if sign and sign not in w]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.ids([(b" " + sign + b" ").join(some).decode()])[0], self.dtype)
            cuts, packed = np.flatnonzero(ids == self.sign_id).tolist(), ids.tobytes()
            width = ids.itemsize
            for word, a, b in zip(some, [-1, *cuts], [*cuts, len(ids)]):
                self.seen[word] = packed[(a + 1) * width : b * width]
        if len(plain) < len(words):
            done = set(plain)
            rest = [w for w in words if w not in done]
            self.seen.update((w, np.array(ids, self.dtype).tobytes()) for w, ids in zip(rest, self.ids([w.decode() for w in rest])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > self.bound:
            self.seen.clear()
        split = [text.encode().split() for text in texts]
        new = {w for words in split for w in words}.difference(self.seen)
        if new:
            self.learn(list(new))
        return [b"".join(map(self.seen.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def encoder_of(path: str, dtype: str) -> Encoder:
    """The worker's own encoder; tasks that follow in the same Python worker find its words."""
    return Encoder(path, dtype)


def id_type(path: str, end_id: int) -> str:
    largest = max([end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if has_scheme(folder) else f"file://{folder}")


def has_scheme(folder: str) -> bool:
    return ":" in folder.split("/", 1)[0]


def write_files(docs: DataFrame, folder: str, path: str, end_id: int, file_bytes_of_text: int = FILE_TEXT) -> DataFrame:
    """Encode ``docs (doc_id, text)`` and write the files; the result, once run, lists them.

    Texts are dealt by ranges of doc_id (nulls first) and sorted; rows with equal doc_id keep an order by their text.
    Each task encodes one range and writes it to one file, under a name of its own that it then renames, so that a
    task run again leaves the same file. A task holds the packed ids of its range.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files, dtype = max(1, -(-total // file_bytes_of_text)), id_type(path, end_id)
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(int(files), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt = dealt.select(F.spark_partition_id().alias("file"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(path, dtype), np.array([end_id], dtype).tobytes()
        ids, keys, number = [], [], None
        for batch in small_batches(batches):
            number = batch.column("file")[0].as_py()
            ids += [packed + end for packed in encoder.encode(batch.column("text").to_pylist())]
            keys += batch.column("doc_id").to_pylist()
        if number is not None:
            system, root = filesystem(folder)
            system.create_dir(root, recursive=True)
            data, count = file_bytes(ids, dtype), sum(map(len, ids)) // np.dtype(dtype).itemsize
            draft = f"{root}/.{number:06d}-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(data)
            system.move(draft, f"{root}/{number:06d}.ids")
            values = [[number], [len(ids)], [count], [zlib.crc32(data)], [keys]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["file", "docs", "ids", "crc32", "doc_ids"])

    return dealt.mapInArrow(run, "file int, docs long, ids long, crc32 long, doc_ids array<long>")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files themselves: doc_id, start over all files, n_tokens, packed ids."""
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    listed = manifest.select("file", "crc32", "doc_ids").join(bases, "file").repartition("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, crc, keys, base in zip(*(batch.column(c) for c in ("file", "crc32", "doc_ids", "base"))):
                system, root = filesystem(folder)
                with system.open_input_stream(f"{root}/{number.as_py():06d}.ids") as source:
                    data = source.read()
                if zlib.crc32(data) != crc.as_py():
                    raise ValueError(f"file {number} is damaged")
                tokens = TokenFile(data)
                ends = tokens.ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ends), 512):
                    a, b = starts[at : at + 512], ends[at : at + 512]
                    rows = [tokens.ids[x:y].astype("<u4").tobytes() for x, y in zip(a, b)]
                    columns = [keys.values[at : at + 512], pa.array(a + base.as_py()), pa.array(b - a), pa.array(rows, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, text_bytes: int = FILE_TEXT) -> DataFrame:
    """Encode ``docs``, write the files to ``folder`` and return the stored list of files.

    A null text counts as empty and gives the end id alone; every row is written, repeated ones too. An empty table
    gives no file. ``folder`` must be shared by all executors. Other columns are not looked at.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return checkpointed(write_files(docs, folder, path, end_id, text_bytes), "manifest")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "token-files")
    manifest = token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    back = read_files(manifest, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
