"""Near dedup of the pipeline goes through the fingerprints of operator (1)."""

import corpus_pipeline
from busweave.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_fingerprints_propose_what_no_band_does(spark):
    # Found by search: similarity 11 of 13, one fingerprint (the repeated words settle every bit), no band in common.
    first = "x y z " * 40 + " ".join(f"w26247a{i}" for i in range(8))
    second = first + " v26247 u26247"
    # The same fingerprint again, but too few shingles in common: proposed, not linked.
    third = "x y z " * 40 + " ".join(f"other{i}" for i in range(8))
    rows = [(5, first), (3, second), (9, third), (None, third + " end"), (7, None), (8, " ")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    by_bands = {r.id: r.component_id for r in nearcopies.near_copies(docs).collect()}
    assert by_bands[5] == 5 and by_bands[3] == 3
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "7", "9", "None"]
