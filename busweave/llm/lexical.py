"""Ranked lexical search: bundles of items visit the owners of the terms one after the other.

Documents are cut into slices. An index in the shared folder holds, per slice and term, the positions and counts of
that term. Terms have owners, by hash. A bundle of items carries, per slice, one sparse accumulator per item and
document; at each owner it is grouped with that owner's postings and integer contributions are added. After the last
owner each slice gives its best documents per item, and the best of those are the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busweave.llm.common import LOWER, UPPER, small_batches
from busweave.session import checkpointed

#: ASCII signs between terms, as the contract's pattern lists them.
SEPARATORS = [range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)]
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Stages of the pipeline, documents and postings of a slice at most, items of a bundle about.
OWNERS, SLICE_DOCS, SLICE_POSTINGS, BUNDLE = 4, 8192, 2_000_000, 128
#: Bits of the table that tells which terms no item holds: 2 MB whatever the number of items.
FILTER_BITS = 1 << 24
#: Shares into which the slices of one term are dealt when postings meet the items, and groups of the first selection.
SHARES = 16


def _table() -> bytes:
    table = bytearray(range(256)).replace(UPPER.encode(), LOWER.encode())
    for signs in SEPARATORS:
        for sign in signs:
            table[sign] = 0x20
    return bytes(table)


TABLE = _table()


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, A-Z lower-cased, repeats included."""
    return (text or b"").translate(TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``(item_id, term)`` of ``items (item_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [list(dict.fromkeys(terms_of(text))) for text in batch.column("text").to_pylist()]
            ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t for s in sets for t in s], pa.binary())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary").distinct()


def wanted_terms(terms: DataFrame) -> bytes:
    """Bit table over the hashes of ``terms.term``; a term whose bit is unset is in no item."""
    bit = F.crc32("term") % FILTER_BITS + 1  # the functions below number bits from 1
    pages = terms.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("page"))
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    for page, bits in pages.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit"))).collect():  # at most 512 of 4 KB
        table[(page - 1) * len(bits) : page * len(bits)] = np.frombuffer(bits, np.uint8)
    return table.tobytes()


INDEX = "slice long, term binary, df long, n_terms long, ids array<long>, docs binary, counts binary"


class Slice:
    """Postings of consecutive documents, gathered until they fill a slice."""

    def __init__(self, number: int):
        self.number, self.ids, self.sizes, self.postings, self.entries = number, [], [], {}, 0

    def add(self, doc_id: int | None, size: int, counts: list[tuple[bytes, int]]) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.entries += len(counts)
        for term, tf in counts:
            got = self.postings.get(term)
            if got is None:
                got = self.postings[term] = ([], [])
            got[0].append(at)
            got[1].append(tf)

    def full(self, docs: int, postings: int) -> bool:
        return len(self.ids) >= docs or self.entries >= postings

    def batches(self) -> Iterator[pa.RecordBatch]:
        """One row of the slice itself, with the sizes of its documents as counts, then one per term."""
        sizes = np.array(self.sizes, "<i8")
        rows = [(None, int((sizes > 0).sum()), int(sizes.sum()), self.ids, b"", sizes.tobytes())]
        for term, (docs, counts) in self.postings.items():
            rows.append((term, len(docs), None, None, np.array(docs, "<u2").tobytes(), np.array(counts, "<u4").tobytes()))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for at in range(0, len(rows), 1024):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows[at : at + 1024]), kinds)]
            number = pa.array(np.full(len(columns[0]), self.number))
            yield pa.RecordBatch.from_arrays([number, *columns], ["slice", "term", "df", "n_terms", "ids", "docs", "counts"])


def build_index(docs: DataFrame, wanted: bytes, slice_docs: int = SLICE_DOCS, slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """Slices of ``docs (doc_id, text)`` and their postings of the ``wanted`` terms, read back from the shared folder.

    Every document is in a slice. A task cuts what it reads into slices of its own, so that no text is shuffled.
    """
    slice_docs = min(slice_docs, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        now, known = Slice(first), {}
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                terms = terms_of(text)
                found = []
                for term, tf in Counter(terms).items():
                    use = known.get(term)
                    if use is None:
                        bit = crc32(term) % FILTER_BITS
                        use = known[term] = bool(wanted[bit >> 3] >> (bit & 7) & 1)
                    if use:
                        found.append((term, tf))
                now.add(doc_id, len(terms), found)
                if now.full(slice_docs, slice_postings):
                    yield from now.batches()
                    now = Slice(now.number + 1)
            if len(known) > 1_000_000:
                known.clear()
        if now.ids:
            yield from now.batches()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return checkpointed(rows.mapInArrow(run, INDEX), "lexical-index")


STATE = "bundle long, slice long, ids array<long>, sizes binary, ends binary, docs binary, scores binary"


def adding(n_docs: int, n_terms: int):
    """Function of a cogroup that adds one owner's contributions to the accumulators of a bundle in a slice."""

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        terms = right.select(["docs", "counts", "slots", "weights"]).to_pylist()
        sizes, ends = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["ends"], "<i8")
        norms = 20 * (50 + 50 * sizes * n_docs // max(n_terms, 1))
        slots = max([len(ends), *(max(t["slots"]) + 1 for t in terms)])
        scores = np.zeros((slots, len(sizes)), np.int64)
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        scores[of, np.frombuffer(row["docs"], "<u2")] = np.frombuffer(row["scores"], "<i8")
        for term in terms:
            docs = np.frombuffer(term["docs"], "<u2")
            tf = np.frombuffer(term["counts"], "<u4").astype(np.int64)
            share = 1_000_000_000 * tf // (1000 * tf + norms[docs])
            for slot, weight in zip(term["slots"], term["weights"]):
                scores[slot, docs] += weight * share
        of, docs = np.nonzero(scores)
        ends = np.cumsum(np.bincount(of, minlength=slots))
        state = left.select(["bundle", "slice", "ids", "sizes"])
        for name, values in (("ends", ends.astype("<i8")), ("docs", docs.astype("<u2")), ("scores", scores[of, docs])):
            state = state.append_column(name, pa.array([values.tobytes()], pa.binary()))
        return state

    return visit


def best_of_slices(state: DataFrame, k: int) -> DataFrame:
    """``(bundle, slot, slice, doc_id, score)`` of the k best documents of each slice for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, scores = np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["scores"], "<i8")
                null = np.array([i is None for i in row["ids"]], bool)
                ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
                best, start = [], 0
                for end in np.frombuffer(row["ends"], "<i8").tolist():
                    at = np.arange(start, end)
                    if len(at) > k:
                        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
                    if len(at) > k:
                        at = at[np.lexsort((ids[docs[at]], null[docs[at]], -scores[at]))[:k]]
                    best.append(at)
                    start = end
                slots, at = np.repeat(np.arange(len(best)), [len(x) for x in best]), np.concatenate([np.zeros(0, int), *best])
                doc_ids = pa.array(ids[docs[at]], mask=null[docs[at]])
                same = [pa.array(np.full(len(at), row[c])) for c in ("bundle", "slice")]
                columns = [same[0], pa.array(slots), same[1], doc_ids, pa.array(scores[at])]
                yield pa.RecordBatch.from_arrays(columns, ["bundle", "slot", "slice", "doc_id", "score"])

    return state.mapInArrow(run, "bundle long, slot long, slice long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, owners: int = OWNERS, bundle: int = BUNDLE, slice_docs: int = SLICE_DOCS
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of every item; scores as the contract has them.

    Null texts hold no term. Rows of ``items`` that share an id (null too) are one item with the terms of all. Every
    row of ``docs`` is a document of its own, repeated ones too. Equal scores go to the smaller doc_id, null last. An
    item without terms, or whose terms no document holds, has no rows, and neither have empty tables. Texts of any
    length are read whole. Other columns are not looked at.
    """
    terms = checkpointed(item_terms(items), "lexical-terms")
    index = build_index(docs, wanted_terms(terms), slice_docs)
    slices, postings = index.where("term IS NULL"), index.where("term IS NOT NULL")
    n_docs, n_terms = slices.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # Items are dealt to bundles by hash and numbered inside them.
    ids = terms.select("item_id").distinct()
    bundles = max(1, -(-ids.count() // bundle))
    ids = ids.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)))
    slot = F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1
    ids = checkpointed(ids.withColumn("slot", slot.cast("long")), "lexical-items")
    # What a bundle asks of a term's owner: the items that hold the term, and its weight.
    df = F.sum("df").alias("df")
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long").alias("weight")
    held = terms.join(ids.withColumnRenamed("item_id", "__id"), F.col("item_id").eqNullSafe(F.col("__id")))
    asked = held.join(postings.groupBy("term").agg(df).select("term", weight), "term").groupBy("bundle", "term")
    asked = checkpointed(asked.agg(F.collect_list("slot").alias("slots"), F.collect_list("weight").alias("weights")), "lexical-asked")
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = postings.withColumn("share", F.pmod(F.xxhash64("slice"), F.lit(SHARES)).cast("int")).join(asked, ["term", "share"])
    met = met.select("bundle", "slice", "term", "docs", "counts", "slots", "weights")

    empty = F.lit(b"")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))).alias("bundle")
    state = slices.select(
        every,
        F.col("slice").alias("slice"),
        "ids",
        F.col("counts").alias("sizes"),
        empty.alias("ends"),
        empty.alias("docs"),
        empty.alias("scores"),
    )
    for owner in range(owners):
        own = met.where(F.pmod(F.xxhash64("term"), F.lit(owners)) == owner)
        both = state.groupBy("bundle", "slice").cogroup(own.groupBy("bundle", "slice"))
        state = both.applyInArrow(adding(n_docs, n_terms), STATE)
    found = best_of_slices(state, k).withColumn("share", F.pmod(F.xxhash64("slice"), F.lit(SHARES)))
    best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["bundle", "slot", "share"], ["bundle", "slot"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))).where(F.col("rank") <= k)
    return found.join(ids, ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return search(docs, items)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
s AS (SELECT count(*) AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
t AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
c AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 50
"""
