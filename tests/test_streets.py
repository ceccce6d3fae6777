"""The q-gram index against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from busweave.operators import streets

NAMES = ["Rua A", "rua a", "", "a", "é", "Av", "Avenida Sete", "zz", "Rua Augusta", None, "--", "%", "_", "日本", "ruaruarua"]
TEXTS = ["Rua Augusta", "Rua A", "Avenida Sete de Setembro", "", "a", "café", None, "x%y_z", "日本橋", "ru", "ruaruaruarua", "Av"]


def all_pairs(names, texts):
    return sorted({(n, t) for n in names for t in texts if n is not None and t is not None and n in t})


@pytest.mark.parametrize("q", [1, 2, 3, 5])
def test_pairs_equal_all_pairs(spark, q):
    names = spark.createDataFrame([(n, 1) for n in NAMES * 2], "name string, gram int")
    texts = spark.createDataFrame([(t, 1) for t in TEXTS * 3], "text string, n int")
    got = streets.containing_pairs(names, texts, q)
    assert got.columns == ["name", "text"]
    assert sorted(tuple(r) for r in got.collect()) == all_pairs(NAMES, TEXTS)


def test_invented_streets_meet_few_others(spark):
    """Every pair that holds is found, once, and hardly any other is compared, though all share a frequent word."""
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = ["Rua " + " ".join(rng.choice(parts) for _ in range(3)) for _ in range(400)]
    names = ["Rua " + rng.choice(parts) for _ in range(100)] + [rng.choice(parts) for _ in range(100)]
    n, t = (spark.createDataFrame([(x,) for x in values], f"{c} string") for values, c in ((names, "name"), (texts, "text")))
    want = all_pairs(names, texts)
    assert sorted(tuple(r) for r in streets.containing_pairs(n, t).collect()) == want
    met = streets.candidate_pairs(n, streets.gram_index(t)).collect()
    assert len(met) == len(set(met))
    assert len(want) <= len(met) < len(set(names)) * len(set(texts)) / 10


def test_empty_tables(spark):
    names = spark.createDataFrame([("a",)], "name string")
    texts = spark.createDataFrame([("a",)], "text string")
    assert streets.containing_pairs(names.limit(0), texts).isEmpty()
    assert streets.containing_pairs(names, texts.where(F.lit(False))).isEmpty()
