"""What the Python workers of the pipeline hold at once."""

import sys
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from busweave.llm import common, toxicity  # noqa: E402


def test_an_epoch_unpacks_one_row_at_a_time():
    rng, bias = np.random.default_rng(5), 1 << toxicity.BITS
    sets = [np.append(np.unique(rng.integers(0, bias, 2000)), bias).astype(np.int32) for _ in range(1500)]
    y = [i % 3 == 0 for i in range(1500)]
    part = pd.DataFrame({"id": range(1500), "y": np.array(y, int), "at": [common.pack(s) for s in sets]})
    z, n, rule = np.zeros(bias + 1), np.zeros(bias + 1), toxicity.Ftrl()
    learn = toxicity.one_pass(SimpleNamespace(value=(z, n)), rule, 2)
    tracemalloc.start()
    moved = learn(part.sample(frac=1, random_state=1))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    unpacked = sum(8 * len(s) for s in sets) / 1e6
    assert unpacked > 23 and peak < 20  # the state and what is returned take up to 15 MB

    rule.learn(z, n, [(sets[i], y[i]) for i in np.random.default_rng(2).permutation(1500)])
    at = np.flatnonzero(n)
    assert (moved["at"] == at).all() and (moved["z"] == z[at]).all() and (moved["n"] == n[at]).all()


def test_words_that_were_forgotten_hash_the_same():
    texts = ["one two three four", "two five six", "", "six one two seven", "one two three four"]
    assert toxicity.Words().bound <= 100_000
    kept, short = toxicity.Words(), toxicity.Words(2)
    for text in texts:
        assert (toxicity.features(text, kept) == toxicity.features(text, short)).all()
    assert len(short.seen) < len(kept.seen)


def test_encoding_holds_one_worker_for_each_core(spark):
    rows = [(1, "some words to encode", "en", "web", 20), (2, None, "en", None, None), (2, "", None, "web", 0), (None, "äöü " * 9, "de", "web", 36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.encode(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in out.collect()) == [(0, True), (1, True), (2, False), (2, False)]
