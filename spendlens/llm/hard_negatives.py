"""Hard-negative mining by angular triangle filtering.

Vectors become integers (floor of ``SCALE`` times a component) and rows are ranked by integer inner
products with an anchor. Each row stores its angles to a few reference directions. By the
triangle inequality of angles, |angle(a, r) - angle(x, r)| <= angle(a, x) <= angle(a, r) + angle(x, r)
(or what is left of a full turn), so the references give an interval for the cosine of a and
x; multiplied by both norms, and widened by more than rounding can lose, it bounds their score.
Only rows whose interval meets the window of scores asked for are scored, in integers.

The references are far apart: picked one by one from a bounded sample of rows, each the one whose
smallest angle to those before is largest. Rows are dealt by ranges of (label, nearest reference,
angle to it, key) and cut into pieces of bounded size, so a crowded label or direction is many
pieces; a piece knows the range of its rows' angles, and an anchor visits only pieces that may hold
a row it wants. Anchors meet a piece in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import written

SCALE = 256
REFERENCES = 16
#: Rows the references are picked from.
SAMPLE = 1_024
PIECE_ROWS = 4_096
BLOCK_ANCHORS = 4_096
#: Radians an angle may be off by; arccos of a rounded cosine is off by at most about 1e-7.
SLACK = 1e-6
#: Rows scored at a time, the most promising first.
CHUNK = 512
#: Longest vectors (squared, in integers) whose products surely fit a long.
LONGEST = 2.0**62


def pick_references(vectors: np.ndarray, many: int) -> np.ndarray:
    """Unit vectors far apart from each other, the first row's direction first."""
    norm = np.sqrt((vectors**2).sum(1))
    units = vectors[norm > 0] / norm[norm > 0, None]
    chosen: list[int] = []
    nearest = np.full(len(units), -np.inf)
    for _ in range(min(many, len(units))):
        best = int(np.argmin(nearest))
        if chosen and nearest[best] > 1 - 1e-9:
            break
        chosen.append(best)
        nearest = np.maximum(nearest, units @ units[best])
    return units[chosen]


def angles_to(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """[row, reference]; a zero vector's angles count as zero, its norm makes every bound zero."""
    norm = np.sqrt((vectors**2).sum(1))
    cosine = (vectors @ references.T) / np.where(norm > 0, norm, 1.0)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1.0, 1.0)), 0.0)


def score_bounds(own: np.ndarray, norm: float, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above the scores of rows with one anchor, safe against rounding."""
    if angles.shape[1]:
        least = np.maximum(np.abs(angles - own).max(1) - 2 * SLACK, 0.0)
        both = angles + own
        most = np.minimum(np.minimum(both, 2 * np.pi - both).min(1) + 2 * SLACK, np.pi)
    else:
        least, most = np.zeros(len(norms)), np.full(len(norms), np.pi)
    size = norms * norm
    widened = size * 1e-9 + 1
    return np.cos(most) * size - widened, np.cos(least) * size + widened


def _integers(items: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = items.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(sound)
    whole = rows.select("id", "label", F.transform("v", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-LONGEST)), F.lit(LONGEST)))).alias("q"))
    squared = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return whole.withColumn("norm", F.sqrt(squared)).where(squared < LONGEST)


def _stack(vectors: pd.Series, kind: type) -> np.ndarray:
    return np.stack([np.asarray(v, kind) for v in vectors])


def _dealt(rows: DataFrame, seed: int) -> tuple[DataFrame, str]:
    """Rows with ``dim``, ``row``, ``angles`` and the ``piece`` they stand in, written."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("q").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["q"]), []).append(r["q"])
    references = {d: pick_references(np.array(vs, np.float64).reshape(len(vs), d), REFERENCES) for d, vs in by_dim.items()}
    shared = spark.sparkContext.broadcast(references)

    @F.pandas_udf("array<double>")
    def angles(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        sizes = vectors.map(len).to_numpy()
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            known = shared.value.get(d, np.zeros((0, d)))
            for i, a in zip(at.tolist(), angles_to(_stack(vectors.iloc[at], np.float64), known)):
                out[i] = a.tolist()
        return pd.Series(out)

    near = F.when(F.size("angles") > 0, F.array_min("angles"))
    placed = (
        rows.withColumn("angles", angles("q"))
        .withColumn("dim", F.size("q"))
        .withColumn("near", near)
        .withColumn("ref", F.array_position("angles", F.col("near")))
        .repartitionByRange("dim", "label", "ref", "near", "id")
        .sortWithinPartitions("dim", "label", "ref", "near", "id")
        .select("dim", "id", "label", "q", "norm", "angles")
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        piece, filled, dim, count = -1, PIECE_ROWS, None, 0
        for batch in batches:
            names = []
            for d in batch["dim"].tolist():
                if filled >= PIECE_ROWS or d != dim:
                    piece, filled, dim = piece + 1, 0, d
                filled += 1
                names.append(first + piece)
            batch["piece"] = np.array(names, np.int64)
            batch["row"] = first + count + np.arange(len(batch))
            count += len(batch)
            yield batch

    schema = "dim int, id long, label string, q array<long>, norm double, angles array<double>, piece long, row long"
    return written(placed.mapInPandas(pieces, schema), "angles")


def _ranges(dealt: DataFrame) -> DataFrame:
    """One row per piece: its labels and the ranges of its norms and angles."""
    each = dealt.select("dim", "piece", "label", "norm", F.posexplode_outer("angles").alias("nth", "angle"))
    by_reference = each.groupBy("dim", "piece", "nth").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.max("norm").alias("norm"),
        F.min("label").alias("first_label"), F.max("label").alias("last_label"),
    )
    return by_reference.groupBy("dim", "piece").agg(
        F.max("norm").alias("longest"), F.min("first_label").alias("first_label"), F.max("last_label").alias("last_label"),
        F.array_sort(F.collect_list(F.struct("nth", "low", "high"))).alias("ranges"),
    )


def _reach() -> Column:
    """Above the score of any row in a piece (``ranges``, ``longest``) with an anchor (``angles``, ``norm``)."""
    apart = F.zip_with("ranges", "angles", lambda r, a: F.greatest(r["low"] - a, a - r["high"], F.lit(0.0)))
    least = F.greatest(F.coalesce(F.array_max(apart), F.lit(0.0)) - 2 * SLACK, F.lit(0.0))
    size = F.col("longest") * F.col("norm")
    # A piece's norms differ: below zero the shortest row would be nearest to zero.
    return F.greatest(F.cos(least) * size, F.lit(0.0)) + size * 1e-9 + 1


class _Piece:
    """The rows of one piece as arrays."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.id, self.row, self.label = rows["id"].to_numpy(), rows["row"].to_numpy(), rows["label"].to_numpy()
        self.norm, self.angles = rows["norm"].to_numpy(), _stack(rows["angles"], np.float64)
        # Below 2**53 products of doubles are exact and faster.
        self.kind = np.float64 if self.norm.max() ** 2 < 2.0**53 else np.int64
        self.q = _stack(rows["q"], self.kind)

    def scores(self, at: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        if self.kind is np.float64 and norm * self.norm.max() < 2.0**53:
            return (self.q[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.q[at].astype(np.int64) @ anchor.astype(np.int64)


def _best(piece: _Piece, anchor, many: int) -> list[tuple]:
    """The ``many`` best other rows of the anchor's label in a piece, scored in order of their bounds."""
    at = np.flatnonzero((piece.label == anchor.label) & (piece.row != anchor.row))
    own = np.asarray(anchor.angles, np.float64)
    _, high = score_bounds(own, anchor.norm, piece.angles[at], piece.norm[at])
    order = np.argsort(-high, kind="stable")
    at, high = at[order], high[order]
    vector = np.asarray(anchor.q, np.int64)
    held, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(at), CHUNK):
        if len(held) == many and high[start] < scores[-1]:
            break
        part = at[start : start + CHUNK]
        held, scores = np.r_[held, part], np.r_[scores, piece.scores(part, vector, anchor.norm)]
        keep = np.lexsort((piece.row[held], piece.id[held], -scores))[:many]
        held, scores = held[keep], scores[keep]
    return [(anchor.row, int(piece.row[i]), int(piece.id[i]), int(s)) for i, s in zip(held, scores)]


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _within(piece: _Piece, anchor, many: int, low: int, high: int) -> list[tuple]:
    """For each positive of the anchor the ``many`` best rows of other labels within its window."""
    windows = [(p["row"], _window(int(p["score"]), low, high)) for p in anchor.positives]
    at = np.flatnonzero(piece.label != anchor.label)
    own = np.asarray(anchor.angles, np.float64)
    below, above = score_bounds(own, anchor.norm, piece.angles[at], piece.norm[at])
    meets = np.zeros(len(at), bool)
    for _, (a, b) in windows:
        if a <= b:
            meets |= (above >= a) & (below <= b)
    at = at[meets]
    scores = piece.scores(at, np.asarray(anchor.q, np.int64), anchor.norm)
    order = np.lexsort((piece.row[at], piece.id[at], -scores))
    at, scores = at[order], scores[order]
    down = -scores
    out = []
    for name, (a, b) in windows:
        if a <= b:
            start = int(np.searchsorted(down, -b, "left"))
            stop = min(start + many, int(np.searchsorted(down, -a, "right")))
            out += [(anchor.row, name, int(piece.row[i]), int(piece.id[i]), int(s)) for i, s in zip(at[start:stop], scores[start:stop])]
    return out


def _meet(dealt: DataFrame, visits: DataFrame, blocks: int, found, schema: str) -> DataFrame:
    """Calls ``found`` (piece, anchor) for each visit, a block of anchors and a piece at a time."""
    posed = visits.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    pairs = posed.select(F.col("piece").alias("at_piece"), F.col("block").alias("at_block")).distinct()
    at = dealt.join(pairs, F.col("piece") == F.col("at_piece"))
    names = [c.split()[0] for c in schema.split(", ")]

    def both(name: tuple, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            piece = _Piece(rows)
            for anchor in anchors.itertuples(index=False):
                out += found(piece, anchor)
        return pd.DataFrame(out, columns=names).astype("int64")

    return at.groupBy("at_piece", "at_block").cogroup(posed.groupBy("piece", "block")).applyInPandas(both, schema)


def mine(
    items: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, seed: int = 13,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    Anchors are the rows where the condition ``anchors`` (on the ``id`` column) holds. An anchor's
    positives are its best other rows of the same label; for each of them the best rows of
    another label whose score is between ``low`` and ``high`` percent of the positive's.
    Ties go to the smaller key. Rows with a null key, label or vector, or a null or non-finite
    component, take no part, nor do vectors too long for products in a long (a norm of 2**31
    after scaling). Vectors only meet others of equal dimension. Repeated rows are rows of
    their own. Other columns are not read. Empty tables give an empty table.
    """
    dealt, _ = _dealt(_integers(items, key, vector, label), seed)
    posed, path = written(dealt.where(anchors).drop("piece"), "anchors")
    blocks = 1 + posed.count() // BLOCK_ANCHORS
    ranges, ranges_path = written(_ranges(dealt), "ranges")

    same = (F.col("label") >= F.col("first_label")) & (F.col("label") <= F.col("last_label"))
    columns = ["piece", "row", "label", "q", "norm", "angles"]
    near = posed.join(ranges, "dim").where(same).select(*columns)
    best = _meet(dealt, near, blocks, lambda p, a: _best(p, a, positives), "row long, positive_row long, positive_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "positive_row")
    kept, kept_path = written(best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "positives")

    lists = kept.groupBy("row").agg(F.collect_list(F.struct(F.col("positive_row").alias("row"), "score")).alias("positives"))
    # Scores grow with positives': the smallest positive one has the lowest window, one below zero none.
    wanted = lists.withColumn("floor", F.array_min(F.filter(F.transform("positives", lambda p: p["score"]), lambda s: s >= 0)) * (low / 100.0))
    far = posed.join(wanted.where("floor is not null"), "row").join(ranges, "dim").where(_reach() >= F.col("floor") - 1)
    far = far.where((F.col("first_label") != F.col("last_label")) | (F.col("label") != F.col("first_label")))
    found = _meet(
        dealt, far.select(*columns, "positives"), blocks, lambda p, a: _within(p, a, negatives, low, high),
        "row long, positive_row long, negative_row long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = posed.select("row", F.col("id").alias("anchor_id"))
    return (
        ranked.join(kept.select("row", "positive_row", "positive_id", F.col("score").alias("positive_score")), ["row", "positive_row"])
        .join(names, "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
