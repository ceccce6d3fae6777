"""Ranked lexical search against a brute-force version."""

import math
import re
from collections import Counter

import pytest

from busweave.llm import lexical

FIXED = str.maketrans(lexical.UPPER, lexical.LOWER)


def brute(docs, items, k):
    """Scores of all pairs by the contract's formula, on plain Python integers."""
    words = [(i, re.findall(lexical.TERM, (text or "").translate(FIXED))) for i, text in docs]
    n_docs, n_terms = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(re.findall(lexical.TERM, (text or "").translate(FIXED)))
    out = []
    for item, terms in asked.items():
        found = []
        for doc_id, w in words:
            tf, score = Counter(w), 0
            for t in terms & set(tf):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + 50 * len(w) * n_docs // n_terms
                score += weight * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id, score))
        found.sort(key=lambda x: x[:3])
        out += [(item, place + 1, f[3], f[4]) for place, f in enumerate(found[:k])]
    return sorted(out, key=str)


DOCS = [
    (3, "The cat sat. THE dog ran"), (1, "the cat sat the dog ran"), (2, None), (5, ""), (4, "Ünïcode straße ÄÖ 日本 the"),
    (7, "cat " * 5000), (8, "dog\x00cat_dog-cat"), (9, "!!! ..."), (None, "the cat sat the dog ran"), (1, "the cat sat the dog ran"),
    *[(100 + i, f"the w{i % 7} w{i % 5} cat{i % 3}") for i in range(60)],
]
ITEMS = [(1, "Cat the DOG"), (2, None), (3, "nothing_here zzz"), (4, "straße 日本"), (5, "the"), (6, "w1 w2 w3 cat0"), (6, "w4"), (None, "dog")]


@pytest.mark.parametrize("owners,bundle,slice_docs,k", [(4, 128, 8192, 50), (3, 2, 5, 4), (1, 1, 1, 2)])
def test_equals_brute_force(spark, owners, bundle, slice_docs, k):
    docs = spark.createDataFrame([(i, t, 9, 8) for i, t in DOCS], "doc_id long, text string, slice int, term int").repartition(3)
    items = spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = lexical.search(docs, items, k, owners, bundle, slice_docs)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(DOCS, ITEMS, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_filter_loses_no_term(spark):
    words = [f"word{i}".encode() for i in range(20000)]
    table = lexical.wanted_terms(spark.createDataFrame([(w,) for w in words], "term binary"))
    bits = [lexical.crc32(w) % lexical.FILTER_BITS for w in words]
    assert len(table) * 8 == lexical.FILTER_BITS and all(table[b >> 3] >> (b & 7) & 1 for b in bits)
    assert sum(x.bit_count() for x in table) == len(set(bits))
