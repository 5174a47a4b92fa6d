"""Ranked lexical search over a length-stratified index.

A document's score for a query sums w * impact(tf, m) over the query's terms: w grows with a
term's rarity, m with the document's length, and impact(tf, m) is
(1000000000 * tf) div (1000 * tf + 8 * m). Documents of equal m form a stratum; in a stratum the
impact depends on tf alone, so postings stand by tf and each impact is computed once per tf.

Building: texts become term counts, which are dealt by ranges of (m, key), so that a crowded
stratum is spread over many tasks by its keys; each task cuts its run into pieces of bounded
size (one m each) and writes a row per piece and term with its postings.

Searching takes the queries in blocks of bounded size. For each query the strata are ordered by
their bounds (the sum of w times the impact of each term's largest tf there). The first
``FIRST_STRATA`` of each query are scored; its k-th best score so far is its threshold, and the
second round scores only pieces whose bound reaches it, the best first. Bounds never lie
below a score, so nothing is lost. What is broadcast is one block's terms, thresholds and visits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import remove, runs_of, written

#: Terms are runs of other characters than these; only A-Z are lower-cased.
_SPLIT = bytes(
    (c | 0x20 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)
#: Bytes of text whose terms are Python objects at a time.
COUNT_BYTES = 1_000_000
PIECE_DOCS = 4_096
PIECE_POSTINGS = 500_000
BLOCK_TERMS = 50_000
FIRST_STRATA = 4
LAST = 2**63 - 1


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def term_counts(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key`` (long), ``n`` terms, and arrays of the different ``terms`` and their ``tfs``."""
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )

    return rows.mapInArrow(_counts, "key long, n long, terms array<string>, tfs array<int>")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in runs_of((x.as_py() for x in batch["text"]), COUNT_BYTES):
            found = [Counter(terms_of(x)) if x else Counter() for x in part]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            names = pa.array([t for c in found for t in c], pa.binary()).cast(pa.string())
            tfs = np.fromiter((v for c in found for v in c.values()), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": batch["key"].slice(at, len(part)),
                    "n": pa.array([sum(c.values()) for c in found], pa.int64()),
                    "terms": pa.ListArray.from_arrays(ends, names),
                    "tfs": pa.ListArray.from_arrays(ends, pa.array(tfs)),
                }
            )


@dataclass(frozen=True)
class Index:
    """Postings by stratum, piece and term, with the totals over all documents.

    A row has ``m``, ``piece``, ``term``, ``df``, ``top`` (its largest tf), and by descending
    tf the ``tfs`` and ``docs`` (places in the piece). The row of the empty term has the ``keys`` of
    the piece, ascending.
    """

    postings: DataFrame
    documents: int
    terms: int


def build(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> Index:
    """An index of every row with a term; repeated rows are documents of their own.

    Null texts have no terms. A null key ranks as the largest long.
    """
    forward, path = written(term_counts(docs, key=key, text=text).where("n > 0"), "term-counts")
    total, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"CAST(25 + ((75 * n * {max(total, 1)}) div {max(length, 1)}) AS BIGINT)")
    dealt = forward.select(m.alias("m"), "key", "terms", "tfs").repartitionByRange("m", "key").sortWithinPartitions("m", "key")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, TaskContext.get().partitionId() << 32)

    schema = "m long, piece long, term string, df long, top int, tfs array<int>, docs array<int>, keys array<long>"
    postings, _ = written(dealt.mapInArrow(pieces, schema), "strata")
    remove(docs.sparkSession, path)
    return Index(postings, total, length)


def _pieces(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted documents into pieces, numbered from ``first``; terms stay in Arrow's buffers."""
    held: list[pa.RecordBatch] = []
    docs = size = count = 0
    place = None
    for batch in batches:
        start = 0
        for at, (m, many) in enumerate(zip(batch["m"].to_pylist(), pc.list_value_length(batch["tfs"]).to_pylist())):
            if docs and (m != place or size + many > PIECE_POSTINGS or docs >= PIECE_DOCS):
                yield _inverted(place, first + count, [*held, batch.slice(start, at - start)])
                held, docs, size, count, start = [], 0, 0, count + 1, at
            docs, size, place = docs + 1, size + many, m
        held.append(batch.slice(start))
    if docs:
        yield _inverted(place, first + count, held)


def _inverted(m: int, piece: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of one piece."""
    coded = pa.concat_arrays([b["terms"].flatten() for b in held]).dictionary_encode()
    term = coded.indices.to_numpy().astype(np.int64)
    tf = pa.concat_arrays([b["tfs"].flatten() for b in held]).to_numpy()
    sizes = pa.concat_arrays([pc.list_value_length(b["tfs"]) for b in held]).to_numpy()
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    # The row of the empty term comes first.
    ends = np.r_[0, np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(term)].astype(np.int32)
    rows = len(ends) - 1
    keys = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.full(rows, len(sizes))].astype(np.int32)), pa.concat_arrays([b["key"] for b in held])
    )
    return pa.RecordBatch.from_pydict(
        {
            "m": pa.array(np.full(rows, m, np.int64)),
            "piece": pa.array(np.full(rows, piece, np.int64)),
            "term": pa.concat_arrays([pa.array([""]), coded.dictionary.cast(pa.string())]),
            "df": pa.array(np.diff(ends).astype(np.int64)),
            "top": pa.array(np.r_[np.int32(0), tf[ends[1:-1]]].astype(np.int32)),
            "tfs": pa.ListArray.from_arrays(ends, pa.array(tf)),
            "docs": pa.ListArray.from_arrays(ends, pa.array(doc)),
            "keys": keys,
        }
    )


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Queries as (key, terms, tfs), so many that a block has at most ``BLOCK_TERMS`` (or is one query)."""
    block, size = [], 0
    for row in term_counts(items, key=key, text=text).where("n > 0").toLocalIterator():
        if block and size + len(row["terms"]) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["key"], row["terms"], row["tfs"]))
        size += len(row["terms"])
    if block:
        yield block


def _weights(index: Index, terms: DataFrame) -> dict[str, int]:
    found = index.postings.select("term", "df").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1))) for r in found.collect()}


def _scorer(block: list[tuple], weights: dict[str, int], k: int, thresholds: list[int], only: dict[int, list[int]] | None, done: dict[int, list[int]]):
    """Scores one piece for the queries whose bound reaches their threshold, the best bound first.

    ``only`` names the queries by stratum (none others are scored), ``done`` those to leave out.
    """
    asked: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    lists: dict[str, list[tuple[int, int]]] = {}
    for q, (_, terms, tfs) in enumerate(block):
        for t, tf in zip(terms, tfs):
            if weights.get(t, 0) > 0:
                lists.setdefault(t, []).append((q, weights[t] * tf))
    for t, pairs in lists.items():
        asked[t] = tuple(np.array(x, np.int64) for x in zip(*pairs))
    least = np.maximum(np.array(thresholds, np.int64), 1)

    def score(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = int(name[0])
        own = rows["term"].to_numpy()
        keys = np.asarray(rows["keys"].to_numpy()[np.flatnonzero(own == "")[0]], np.int64)
        places = [i for i in range(len(own)) if own[i] in asked]
        out: list[tuple] = []
        if places:
            tfs = [np.asarray(rows["tfs"].iat[i], np.int64) for i in places]
            docs = [np.asarray(rows["docs"].iat[i], np.int64) for i in places]
            # An impact is computed once for each tf of the stratum's piece.
            values, which = np.unique(np.concatenate(tfs), return_inverse=True)
            impacts = np.split(impact(values, m)[which], np.cumsum([len(x) for x in tfs])[:-1])
            posted = [asked[own[i]] for i in places]
            bound = np.zeros(len(block), np.int64)
            for (q, w), gained in zip(posted, impacts):
                bound[q] += w * gained[0]
            reach = bound >= least
            if only is not None:
                mine = np.zeros(len(block), bool)
                mine[only.get(m, [])] = True
                reach &= mine
            reach[done.get(m, [])] = False
            terms_by_query: dict[int, list[tuple[int, int]]] = {int(q): [] for q in np.flatnonzero(reach)}
            for at, (q, w) in enumerate(posted):
                for x, weight in zip(q[reach[q]].tolist(), w[reach[q]].tolist()):
                    terms_by_query[x].append((at, weight))
            for q in sorted(terms_by_query, key=lambda x: -bound[x]):
                total = np.zeros(len(keys), np.int64)
                for at, weight in terms_by_query[q]:
                    total[docs[at]] += weight * impacts[at]
                good = np.flatnonzero(total >= least[q])
                best = good[np.lexsort((good, -total[good]))[:k]]
                out += zip([q] * len(best), keys[best].tolist(), total[best].tolist())
        return pd.DataFrame(out, columns=["query", "key", "score"]).astype("int64")

    return score


def search(
    index: Index, items: DataFrame, *, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id", k: int = 10
) -> DataFrame:
    """``item_key``, ``rank`` (from 1), ``key`` and ``score`` of each query's ``k`` best documents.

    Only documents with a score above 0; of equal scores the smaller key comes first, a null one last.
    Queries without a term find nothing; repeated queries are answered each. Other columns
    are not read. An empty index or no queries give an empty table.
    """
    spark = items.sparkSession
    answers = [_answer(index, block, k) for block in _blocks(items, item_key, item_text)]
    if not answers:
        answers = [spark.createDataFrame([], "item long, rank int, key long, score long")]
    both = reduce(DataFrame.unionByName, answers)
    named = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return both.select(named("item").alias(item_key), "rank", named("key").alias(key), "score")


def _answer(index: Index, block: list[tuple], k: int) -> DataFrame:
    spark = index.postings.sparkSession
    terms = spark.createDataFrame([(t,) for t in {t for _, ts, _ in block for t in ts}], "term string")
    weights = _weights(index, terms)
    asked = spark.createDataFrame(
        [(q, t, weights[t] * tf) for q, (_, ts, tfs) in enumerate(block) for t, tf in zip(ts, tfs) if weights.get(t)],
        "query long, term string, weight long",
    )
    # The row of the empty term brings the keys of a piece along.
    wanted = F.broadcast(terms.unionByName(spark.createDataFrame([("",)], "term string")))
    matched = index.postings.join(wanted, "term", "left_semi")

    tops = index.postings.join(F.broadcast(asked), "term").groupBy("query", "m", "term").agg(F.max("top").cast("long").alias("top"), F.first("weight").alias("weight"))
    bounds = tops.groupBy("query", "m").agg(F.sum(F.expr("weight * ((1000000000 * top) div (1000 * top + 8 * m))")).alias("bound"))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "m")
    first: dict[int, list[int]] = {}
    for r in bounds.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= FIRST_STRATA).collect():
        first.setdefault(r["m"], []).append(r["query"])

    def scored(rows: DataFrame, *args) -> DataFrame:
        return rows.groupBy("m", "piece").applyInPandas(_scorer(block, weights, k, *args), "query long, key long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    cut = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    visited = matched.where(F.col("m").isin(list(first)))
    early, _ = written(cut(scored(visited, [0] * len(block), first, {})), "first-strata")
    thresholds = [0] * len(block)
    for r in early.where(F.col("rank") == k).collect():
        thresholds[r["query"]] = r["score"]
    late = scored(matched, thresholds, None, first)
    names = spark.createDataFrame([(q, name) for q, (name, _, _) in enumerate(block)], "query long, item long")
    return cut(early.drop("rank").unionByName(late)).join(F.broadcast(names), "query").select("item", "rank", "key", "score")
