"""Periodic runs of words, found in a Re-Pair grammar of the word ids.

Pairs that occur often are replaced by new symbols until no pair occurs twice, which gives rules ``X -> Y Z``; what is
left of each text is paired up evenly. Every run lies in some symbol's words and crosses the boundary between its two
parts, so that each rule's boundary is looked at once, for its first place, and the runs found are carried over to all
places the symbol derives to. Runs held by a longer one of the same period are dropped.

Texts are handled in batches of bounded size with one grammar each, so that copies of a text cost little.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busweave.llm.common import small_batches

#: A run's least length in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that share a grammar; a longer text has one of its own.
BATCH_BYTES = 2_000_000


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes of integers."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeated(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that can lie in a run, and the number of the stretch of text each of them belongs to.

    Any two neighbouring words of a run occur side by side at least three times in it. So a text is cut wherever two
    neighbours occur together less often, stretches shorter than a run go, and what is left is cut again by the counts
    inside each stretch. Pairs are counted by a hash, which can only make counts larger: no run is lost.
    """
    at, stretch = np.arange(len(words)), texts
    while len(at):
        joined = (stretch[1:] == stretch[:-1]) & (at[1:] == at[:-1] + 1)
        key = mixed(mixed(mixed(stretch[:-1]) + words[at[:-1]].astype(np.uint64)) + words[at[1:]].astype(np.uint64))
        bits = max(10, int(len(at) * 8).bit_length())
        key = (key >> np.uint64(64 - bits)).astype(np.int64)
        often = np.bincount(key[joined], minlength=1 << bits)[key] >= LEAST_PERIODS - 1
        first = np.concatenate([[True], ~(joined & often)])
        number = np.cumsum(first) - 1
        keep = np.bincount(number)[number] >= LEAST_WORDS
        shrunk = len(at) - int(keep.sum())
        at, stretch = at[keep], number[keep]
        if shrunk * 20 < len(keep):
            break
    return at, stretch


def places_in_turn(same_as_before: np.ndarray) -> np.ndarray:
    """Place of each element in its stretch, where True continues the stretch before."""
    at = np.arange(len(same_as_before))
    return at - np.maximum.accumulate(np.where(same_as_before, 0, at))


class Nodes:
    """Symbols with the places they derive to: rule, start, middle and end (word numbers) of each."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, rule: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        self.parts.append((rule, start, middle, end))

    def all(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(column) for column in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 4


def derive(symbols: np.ndarray, starts: np.ndarray, stretch: np.ndarray) -> Nodes:
    """Re-Pair over ``symbols``, pairs inside a stretch only; then what is left of each stretch is paired up evenly.

    In a round every pair that is more frequent than the pairs it overlaps is replaced (ties by a hash of the pair, so
    that repeats are parsed alike); in a row of equal symbols, every other pair counts. The most frequent pair always
    wins, so rounds end when none occurs twice.
    """
    nodes, ends, fresh = Nodes(), starts + 1, int(symbols.max(initial=0)) + 1
    frequent = True
    while True:
        near = stretch[1:] == stretch[:-1]
        if not near.any():
            return nodes
        if frequent:
            key = np.where(near, symbols[:-1] * fresh + symbols[1:], -1 - np.arange(len(near)))
            again = np.concatenate([[False], key[1:] == key[:-1]])
            pair = np.flatnonzero(near & (places_in_turn(again) % 2 == 0))
            kinds, kind, counts = np.unique(key[pair], return_inverse=True, return_counts=True)
            order = np.lexsort((mixed(kinds), counts))
            place = np.empty(len(kinds), np.int64)
            place[order] = np.arange(1, len(kinds) + 1)
            place[counts < 2] = 0
            rank = np.zeros(len(near) + 2, np.int64)
            rank[pair + 1] = place[kind]
            chosen = (rank[1:-1] > rank[:-2]) & (rank[1:-1] > rank[2:])
            left = np.flatnonzero(chosen)
            kinds, rule = np.unique(key[left], return_inverse=True)
            # A pair that wins in one place only makes no rule.
            once = np.bincount(rule, minlength=len(kinds)) < 2
            left, rule = left[~once[rule]], rule[~once[rule]]
            frequent = len(left) > 0
        if not frequent:
            offset = places_in_turn(np.concatenate([[False], near]))
            left = np.flatnonzero(near & (offset[:-1] % 2 == 0))
            rule = np.arange(len(left))
        rule = rule + fresh
        nodes.add(rule, starts[left], starts[left + 1], ends[left + 1])
        symbols, ends = symbols.copy(), ends.copy()
        symbols[left], ends[left] = rule, ends[left + 1]
        keep = np.ones(len(symbols), bool)
        keep[left + 1] = False
        symbols, starts, ends, stretch = symbols[keep], starts[keep], ends[keep], stretch[keep]
        fresh += int(rule.max() - fresh) + 1 if len(rule) else 0


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges ``first <= x < last`` one after the other, and the number of the range of each."""
    sizes = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(first)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of], of


class Squares:
    """Whether two neighbouring blocks of a length are equal, by hash: false alarms at worst."""

    def __init__(self, words: np.ndarray):
        self.powers = np.cumprod(np.full(len(words) + 1, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words) * self.powers[:-1], dtype=np.uint64)])

    def at(self, start: np.ndarray, q: np.ndarray) -> np.ndarray:
        one, two = self.sums[start + q] - self.sums[start], self.sums[start + 2 * q] - self.sums[start + q]
        return one * self.powers[q - 1] == two


def extended(words: np.ndarray, low: int, high: int, at: int, q: int) -> tuple[int, int]:
    """The words around ``at`` in ``low .. high`` that keep period ``q``, given that those of ``at .. at + 2q`` may."""
    differ = np.flatnonzero(words[low : high - q] != words[low + q : high])
    before, after = np.searchsorted(differ, at - low), np.searchsorted(differ, at - low + q)
    if before != after:  # the hash was wrong
        return at, at
    start = low + int(differ[before - 1]) + 1 if before else low
    return start, low + int(differ[after]) + q if after < len(differ) else high


def crossing(words: np.ndarray, places: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs that cross the middle of each range, as ``(range, first word, end, period)``, inside the range.

    On the longer side of the middle a run holds two equal blocks of one period, and the two words at the middle occur
    again one period to that side. Periods that pass both tests are extended word by word, small ones first; multiples
    of a period whose run holds the blocks are skipped.
    """
    pairs = places[:-1][np.diff(places) == 1]
    _, kind = np.unique(words[pairs] * (int(words.max(initial=0)) + 1) + words[pairs + 1], return_inverse=True)
    size = len(words) + 1
    listed = np.sort(kind * size + pairs)
    kind_at = np.full(len(words), -1)
    kind_at[pairs] = kind
    base = kind_at[middle - 1] * size
    most = (end - start) // LEAST_PERIODS
    first = np.searchsorted(listed, base + np.maximum(start, middle - 1 - most))
    last = np.searchsorted(listed, base + np.minimum(end - 2, middle - 1 + most), "right")
    there, of = spread(np.where(base < 0, 0, first), np.where(base < 0, 0, last))
    # To the left: the pair at the middle is the one a period before; the block before the middle equals the one before it.
    c = middle[of]
    step = listed[there] - base[of] - c + 1
    q, at = np.abs(step), np.where(step < 0, c + 2 * step, c)
    fits = (step != 0) & (at >= start[of]) & (at + 2 * q <= end[of])
    of, q, at = of[fits], q[fits], at[fits]
    equal = Squares(words).at(at, q)
    of, q, at = of[equal], q[equal], at[equal]
    order = np.lexsort((q, of))
    of, q, at_all = of[order], q[order], at[order]
    found = []
    bounds = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, int)
    for a, b in zip(bounds[:-1], bounds[1:]):
        node = int(of[a])
        low, high, at, period = int(start[node]), int(end[node]), at_all[a:b], q[a:b]
        while len(at):
            p = int(period[0])
            s, e = extended(words, low, high, int(at[0]), p)
            held = np.zeros(len(at), bool)
            held[0] = True
            if e - s >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.append((node, s, e, p))
                held |= (period % p == 0) & (at >= s) & (at + 2 * period <= e)
            at, period = at[~held], period[~held]
    return found


def find_runs(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and period of all runs of the concatenated ``words``, none across two ``texts``, by first word."""
    none = np.zeros(0, np.int64)
    places, stretch = repeated(words, texts)
    if not len(places):
        return none, none, none
    rule, start, middle, end = derive(words[places], places, stretch).all()
    long = end - start >= LEAST_WORDS
    rule, start, middle, end = rule[long], start[long], middle[long], end[long]
    rules, once, of = np.unique(rule, return_index=True, return_inverse=True)
    found = crossing(words, places, start[once], middle[once], end[once])
    if not found:
        return none, none, none
    number, s, e, p = np.array(found).T
    origin = start[once][number]
    # All places of each rule: nodes in the order of their rules.
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(rules)))
    there, which = spread(np.concatenate([[0], ends])[number], ends[number])
    shift = start[order[there]] - origin[which]
    s, e, p = s[which] + shift, e[which] + shift, p[which]
    # Of one period, a run held by another one ends no later than one that began earlier.
    order = np.lexsort((-e, s, p))
    s, e, p = s[order], e[order], p[order]
    base = p * (len(words) + 1)
    reach = np.maximum.accumulate(base + e)
    kept = np.concatenate([[True], base[1:] + e[1:] > np.maximum(reach[:-1], base[1:])])
    s, e, p = s[kept], e[kept], p[kept]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def drawn(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where each word comes from in a text whose end the contract makes periodic, else None."""
    if doc_id is None or not n:
        return None
    g, turn = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if turn:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def rows_of(ids: list[int | None], texts: list[bytes | None], plant: bool) -> list[tuple]:
    """Result rows of a batch of texts."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split, codes, sources = [], [], []
    for doc_id, text in zip(ids, texts):
        words = (text or b"").split()
        code = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        source = drawn(doc_id, len(words)) if plant else None
        split.append(words)
        codes.append(code if source is None else code[source])
        sources.append(source)
    sizes = np.array([len(c) for c in codes])
    firsts = np.cumsum(sizes) - sizes
    starts, ends, periods = find_runs(np.concatenate([np.zeros(0, np.int64), *codes]), np.repeat(np.arange(len(ids)), sizes))
    bounds = np.searchsorted(starts, np.concatenate([firsts, firsts[-1:] + sizes[-1:]]))
    rows = []
    for i, (words, source) in enumerate(zip(split, sources)):
        own = slice(bounds[i], bounds[i + 1])
        s, e, p = starts[own] - firsts[i], ends[own] - firsts[i], periods[own]
        if source is not None:
            words = [words[j] for j in source.tolist()]
        best = (None,) * 4
        if len(s):
            k = int(np.lexsort((p, s, s - e))[0])
            length = int(e[k] - s[k])
            best = (int(s[k]), length, int(p[k]), 1000 * length // int(p[k]))
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, s + p, 1)
            np.add.at(change, e, -1)
            words = [words[j] for j in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in zip(s.tolist(), e.tolist(), p.tolist()))
        digests = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), b" ".join(words))]
        rows.append((ids[i], len(s), *best, *digests))
    return rows


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Runs of every text: their number, the longest one, and digests of all runs and of the text without repeats.

    One row per row of ``docs``, repeated ones too. Null and empty texts have no words and so no run. With ``plant``
    the contract's rule first makes the end of some texts periodic, by their id; a null id is left as it is. Texts of
    any length are read whole; other columns are not looked at. An empty table gives an empty result.
    """
    names, kinds = zip(*(c.split(" ") for c in COLUMNS.split(", ")))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(v, pa.int64() if k == "long" else pa.string()) for v, k in zip(zip(*rows), kinds)], list(names)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in small_batches(batches, 64):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or b"")
                if size >= batch_bytes:
                    yield batch_of(rows_of(ids, texts, plant))
                    ids, texts, size = [], [], 0
        if ids:
            yield batch_of(rows_of(ids, texts, plant))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, COLUMNS)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
