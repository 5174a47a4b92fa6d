"""Approximate nearest neighbours with a hash-prefix forest.

Rows are dealt into shards. In each shard every tree has a random sequence of hyperplanes;
a row's signs are its hash string, and the tree is the sorted array of these strings (Bawa et
al., 2005). A query descends each tree to its longest matching prefix, a range of the array, and
ascends all trees together, a shorter prefix at a time, until the ranges hold ``share`` of
the shard (a row counts in each tree that has it) and one of them more than ``k`` rows. Those candidates are scored exactly on the
original vectors, and no others; the best of each shard meet by query.

For inner products of vectors of different lengths, rows get one more coordinate that makes
them equally long, queries a zero (Neyshabur and Srebro, 2015). Shards and blocks of queries
are of bounded size, and each pair of them is one group; the data are sent once for every
block of queries, the queries once for every shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8_192
BLOCK_QUERIES = 4_096
TREES = 64
LENGTH = 32
#: Candidates to gather, as a share of the rows, repeats over trees included.
SHARE = 0.75
#: Queries that descend together in a task.
CHUNK = 64


def _codes(points: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings as numbers, first sign highest: [tree, row]."""
    signs = np.einsum("nd,tld->tln", points, planes, optimize=True) > 0
    out = np.zeros((len(planes), len(points)), np.int64)
    for bit in range(planes.shape[1]):
        out = (out << 1) | signs[:, bit]
    return out


class Forest:
    """Sorted arrays of hash strings over some vectors of one shard."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int, length: int, seed: int) -> None:
        self.vectors = vectors
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        self.planes = np.random.default_rng(seed).normal(size=(trees, length, vectors.shape[1] + 1))
        codes = _codes(np.c_[scaled, rest], self.planes)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, 1)

    def candidates(self, queries: np.ndarray, wanted: float, least: int) -> np.ndarray:
        """Which rows each query gathers: [query, row]; ``least`` different ones, if there are."""
        trees, length = self.planes.shape[:2]
        n, asked = len(self.vectors), len(queries)
        codes = _codes(np.c_[queries, np.zeros(asked)], self.planes)
        low = np.zeros((trees, asked), np.int64)
        high = np.zeros((trees, asked), np.int64)
        open_ = np.arange(asked)
        for prefix in range(length, -1, -1):
            if not len(open_):
                break
            for tree in range(trees):
                head = codes[tree, open_] >> (length - prefix) << (length - prefix)
                low[tree, open_] = np.searchsorted(self.codes[tree], head, "left")
                high[tree, open_] = np.searchsorted(self.codes[tree], head | ((1 << (length - prefix)) - 1), "right")
            held = high[:, open_] - low[:, open_]
            open_ = open_[(held.sum(0) < min(wanted, trees * n)) | (held.max(0) < min(least, n))]
        found = np.zeros((asked, n), bool)
        for tree in range(trees):
            for q in range(asked):
                found[q, self.order[tree, low[tree, q] : high[tree, q]]] = True
        return found


def nearest_of(rows: np.ndarray, vectors: np.ndarray, point: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of ``rows`` by inner product with ``point``, equal ones by row, and their products.

    Each product is summed over its own row alone, so equal vectors have equal products.
    """
    score = np.einsum("nd,d->n", vectors[rows], point)
    if len(rows) > k:
        # All that tie with the last one to stay are sorted, none is cut by chance.
        able = score >= np.partition(score, len(rows) - k)[len(rows) - k]
        rows, score = rows[able], score[able]
    order = np.lexsort((rows, -score))[:k]
    return rows[order], score[order]


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null").where(sound & F.exists("v", lambda x: x != 0))


def search(
    items: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    trees: int = TREES, length: int = LENGTH, share: float = SHARE, seed: int = 5,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``key`` and ``score`` of the ``k`` nearest found.

    Nearness is the inner product in double precision, ties go to the smaller key. Rows with
    the query's own key are no candidates. Null or zero vectors, vectors with a null or
    non-finite component and rows without a key take no part; vectors only meet others
    of equal dimension. Repeated rows are found as often as they occur. Other columns are not
    read. Empty tables give an empty table.
    """
    rows, asked = _usable(items, key, vector), _usable(queries, key, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, longest = rows.select(norm.alias("norm")).agg(F.count("*"), F.max("norm")).first()
    shards = 1 + (n or 0) // SHARD_ROWS
    blocks = 1 + asked.count() // BLOCK_QUERIES
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = (
        rows.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    )
    posed = (
        asked.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    )

    def nearest(name: tuple, own: pd.DataFrame, posed: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []})
        if own.empty or posed.empty:
            return empty
        # Rows stand by id, so ties by row are ties by id.
        own = own.sort_values("id", kind="stable")
        ids, vectors = own["id"].to_numpy(), np.stack(own["v"].to_numpy())
        forest = Forest(vectors, longest, trees, length, seed)
        names, points = posed["id"].to_numpy(), np.stack(posed["v"].to_numpy())
        best = []
        for at in range(0, len(names), CHUNK):
            part = slice(at, at + CHUNK)
            found = forest.candidates(points[part], share * len(ids), k + 1) & (ids[None, :] != names[part, None])
            best += [nearest_of(np.flatnonzero(row), vectors, point, k) for point, row in zip(points[part], found)]
        chosen, score = (np.concatenate(x) for x in zip(*best))
        return pd.DataFrame({"query_id": np.repeat(names, [len(rows) for rows, _ in best]), "id": ids[chosen], "score": score})

    by = ["dim", "shard", "block"]
    id_type = rows.schema["id"].dataType.simpleString()
    pairs = dealt.groupBy(*by).cogroup(posed.groupBy(*by)).applyInPandas(nearest, f"query_id {id_type}, id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
