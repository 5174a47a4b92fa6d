"""One row of each group of near-duplicates."""

from __future__ import annotations

import corpus_pipeline
from spendlens.llm import simhash

DOCS = "doc_id long, text string"


def test_pipeline_links_by_fingerprints(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:-1]), "quite another text with words of its own"]
    a, b = (simhash.fingerprint(t) for t in texts[:2])
    assert (a ^ b).bit_count() <= 2
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_one_row_of_each_component_whatever_the_keys(spark):
    rows = [(None, "a b"), (None, "A b"), (None, "c d"), (3, "C d"), (7, "C  d"), (7, "e f"), (7, "E f"), (None, "g h")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept) == [(0, "a b"), (0, "g h"), (3, "c d"), (7, "e f")]
