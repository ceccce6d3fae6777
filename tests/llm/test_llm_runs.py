"""Periodic runs against a brute-force version that tries every period at every word."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from busweave.llm import runs


def brute(words):
    """All runs as (first word, end, period), by first word and period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            smaller = any(all(words[x] == words[x + r] for x in range(s, e - r)) for r in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def invented(seed, count):
    random.seed(seed)
    texts = []
    for _ in range(count):
        letters = random.choice([1, 2, 3, 5, 30])
        words = [f"w{random.randrange(letters)}" for _ in range(random.randint(0, 90))]
        for _ in range(random.randint(0, 3)):
            root = [f"w{random.randrange(letters + 2)}" for _ in range(random.randint(1, 9))]
            at = random.randint(0, len(words))
            words[at:at] = (root * 8)[: random.randint(1, 8 * len(root))]
        texts.append(random.choice([" ", "  ", "\n", "\t "]).join(words))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_invented_texts(seed):
    texts = invented(seed, 200)
    split = [t.split() for t in texts]
    names = {w: i for i, w in enumerate(sorted({w for words in split for w in words}))}
    sizes = [len(w) for w in split]
    start, end, period = runs.find_runs(np.array([names[w] for words in split for w in words]), np.repeat(np.arange(len(split)), sizes))
    want = [(s + off, e + off, q) for words, off in zip(split, np.cumsum([0, *sizes[:-1]])) for s, e, q in brute(words)]
    assert want and list(zip(start.tolist(), end.tolist(), period.tolist())) == want


@pytest.mark.parametrize("batch_bytes", [1, 3000, runs.BATCH_BYTES])
def test_rows_equal_brute_force(spark, batch_bytes):
    texts = [*invented(7, 120), None, "", " \t\n", "x", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "A a A a A a A a", "ü ü ü ü ü ü\x0bü"]
    rows = [(i * 17 - 40, t, "n", 1) for i, t in enumerate(texts)] + [(None, "b b b b b b c", "n", 1), (3, texts[0], "n", 1), (3, texts[0], "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start int").repartition(2)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    for plant in (True, False):
        got = runs.periodic_runs(docs, plant=plant, batch_bytes=batch_bytes)
        want = [brute_row(i, t, plant) for i, t, *_ in rows]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_contract_types_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    got = runs.periodic_runs(docs)
    assert got.count() == 0
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [
        ("runs_sha256", "string"), ("collapsed_sha256", "string")]


@pytest.mark.parametrize("root", [["a"], ["a", "b"], ["a", "a", "b"], [f"w{i}" for i in range(997)]])
def test_long_periodic_text_is_quick(root):
    words = (root * 60000)[:60000]
    began = time.process_time()
    row = runs.rows_of([1], [" ".join(words).encode()], False)[0]
    assert row[1:6] == (1, 0, 60000, len(root), 60000 * 1000 // len(root))
    assert time.process_time() - began < 5


def test_copies_share_the_grammar():
    text = " ".join(f"w{i % 50} x{i % 50}" for i in range(2000)).encode()
    began = time.process_time()
    rows = runs.rows_of(list(range(200)), [text] * 200, False)
    assert {r[1:] for r in rows} == {rows[0][1:]} and rows[0][1:5] == (1, 0, 4000, 100)
    assert time.process_time() - began < 20
