"""Mixtures of nearly equal sources, and the order in which copies are emitted."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spendlens.llm import mixing


def entropy(spark, tokens, target):
    known = F.array(*[F.lit(t).cast("long") for t in tokens])
    sizes = spark.range(0, len(tokens), 1, 1).select(F.col("id").alias("source"), F.get(known, F.col("id").cast("int")).alias("tokens"))
    weights = [r["weight"] for r in mixing.weights(sizes, target).collect()]
    assert abs(sum(weights) - 1) < 1e-9
    return -sum(w * math.log(w) for w in weights if w > 0) / math.log(len(tokens)), weights


def test_exponents_beyond_four(spark):
    near = [1000 + i for i in range(20)]
    got, _ = entropy(spark, near, mixing.Target(entropy=0.95, repeats=50.0))
    assert abs(got - 0.95) < 1e-6
    _, weights = entropy(spark, near, mixing.Target(entropy=0.2, repeats=2.0))
    assert abs(max(w * sum(near) / t for w, t in zip(weights, near)) - 2.0) < 1e-6
    with pytest.warns(UserWarning, match="equally large"):
        got, weights = entropy(spark, [7] * 4, mixing.Target(entropy=0.5, repeats=50.0))
    assert weights == [0.25] * 4


def test_copies_come_with_epoch_and_place(spark):
    rows = [(i, "w " * (1 + i % 3), "ab"[i % 4 == 0]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = mixing.Target(entropy=1.0, repeats=4.0)
    out = mixing.emitted(docs, target).select("doc.*", "epoch", "block", "place").collect()
    assert len(out) == mixing.plan(docs, target).agg(F.sum("copies")).first()[0] == mixing.mix(docs, target).count()
    orders = defaultdict(list)
    for r in sorted(out, key=lambda r: r["place"]):
        assert r["block"] == r["place"] >> 48
        orders[r["source"], r["epoch"]].append(r["doc_id"])
    epochs = {s: max(e for t, e in orders if t == s) for s, _ in orders}
    for (source, epoch), ids in orders.items():
        assert len(ids) == len(set(ids))
        if epoch < epochs[source]:
            assert set(ids) == {i for i, _, s in rows if s == source}
    assert orders["b", 0] != orders["b", 1][: len(orders["b", 0])]
