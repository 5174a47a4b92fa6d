"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised. The
exponent is bisected until the weights have the target entropy, or, where that would repeat
some source too often, until the most repeated one just meets the limit. Both are monotone
in the exponent. The upper bound is doubled until the entropy falls below the target. It never
does where the largest sources are equal and so many that they alone exceed it (equal shares, for one):
then the exponent is 1, with a warning. Each round of the bisection evaluates a grid (four halvings at once) by one
aggregation over the table of sources, which never leaves Spark.

A source's budget is its weight times the token budget. It is realised by permutations of
the source, one for each epoch: whole epochs first, then the rows of the next permutation in
order, as long as their tokens fit. A permutation is an order by hash, cut into blocks;
only the block in which the budget ends is summed row by row. Each copy comes with its epoch, block
and place: a source is emitted in the order of epoch and place.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import written

#: Blocks of a permutation: the top bits of the hash.
BLOCK_BITS = 16
GRID = 16
ROUNDS = 11
#: Doublings of the upper bound of the exponent; beyond it shares differ by rounding only.
DOUBLINGS = 60


@dataclass(frozen=True)
class Target:
    """What the weights have to meet.

    ``entropy`` is a share of the largest possible one (0 to 1, equal weights), ``repeats``
    how often a source may be seen at most, ``budget`` the tokens to emit (None: as many as
    there are). The limit on repeats goes before the entropy; where even the natural shares
    break it, because the budget is that large, the exponent is 1 and the limit is exceeded.
    """

    entropy: float = 0.9
    repeats: float = 4.0
    budget: int | None = None


def words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t-\r]+"))).cast("long")


def exponent(sizes: DataFrame, target: Target) -> float:
    """Of ``sizes`` (tokens by source, in column ``tokens``)."""
    sizes = sizes.where("tokens > 0")
    total, n, least, most = sizes.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n or n == 1:
        return 1.0
    ties = sizes.where(F.col("tokens") == most).count()
    budget = float(target.budget if target.budget is not None else total)
    # Relative to the largest source, so that no exponent makes all of them zero.
    share = F.log(F.col("tokens") / F.lit(float(most)))

    def measures(points: list[float]) -> list[tuple[float, float, float]]:
        """Entropy and how often the smallest and the largest source are seen."""
        sums = [x for p in points for x in (F.sum(F.exp(share * p)), F.sum(F.exp(share * p) * share))]
        row = sizes.agg(*[s.alias(str(i)) for i, s in enumerate(sums)]).first()
        out = []
        for i, p in enumerate(points):
            z, s = row[2 * i], row[2 * i + 1]
            out.append((math.log(z) - p * s / z, (least / most) ** p / z * budget / least, budget / z / most))
        return out

    wanted = target.entropy * math.log(n)

    def bisect(low: float, high: float, flat: Callable[[tuple[float, float, float]], bool]) -> float:
        """The smallest exponent that is not too flat."""
        for _ in range(ROUNDS):
            points = [low + (high - low) * i / GRID for i in range(1, GRID)]
            known = [flat(m) for m in measures(points)]
            below = [p for p, f in zip(points, known) if f]
            above = [p for p, f in zip(points, known) if not f]
            low, high = max(below, default=low), min(above, default=high)
        return high

    def above(entropy: float) -> bool:
        return entropy > wanted

    high = None
    if math.log(ties) < wanted:
        for start in range(0, DOUBLINGS, GRID):
            points = [2.0**i for i in range(start, start + GRID)]
            high = next((p for p, m in zip(points, measures(points)) if not above(m[0])), None)
            if high:
                break
    if high is None:
        warnings.warn(f"no exponent brings the entropy down to {target.entropy}: {ties} sources are equally large", stacklevel=2)
        by_entropy = 1.0
    else:
        by_entropy = bisect(0.0, high, lambda m: above(m[0]))
    if by_entropy > 1.0 and budget / total >= target.repeats:
        by_entropy = 1.0
    if by_entropy > 1.0 and measures([by_entropy])[0][2] > target.repeats:
        by_entropy = bisect(1.0, by_entropy, lambda m: m[2] <= target.repeats)
    by_repeats = 1.0 if budget / total >= target.repeats else bisect(0.0, 1.0, lambda m: m[1] > target.repeats)
    if measures([0.0])[0][1] <= target.repeats:
        by_repeats = 0.0
    return max(by_entropy, by_repeats)


def weights(sizes: DataFrame, target: Target) -> DataFrame:
    """``sizes`` with ``weight``, ``quota`` (tokens), ``epochs`` (whole ones) and ``rest`` (tokens)."""
    power = exponent(sizes, target)
    total, most = sizes.agg(F.sum("tokens"), F.max("tokens")).first()
    budget = float(target.budget if target.budget is not None else total or 0)
    share = F.col("tokens") / F.lit(float(most or 1))
    raw = sizes.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(share, power)).otherwise(0.0))
    norm = raw.agg(F.sum("raw")).first()[0] or 1.0
    return (
        raw.withColumn("weight", F.col("raw") / F.lit(norm))
        .withColumn("quota", F.floor(F.col("weight") * budget + 1e-6))
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(0))
        .drop("raw")
    )


def _place(key: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(key, epoch.cast("long"), F.lit(seed))


def plan(docs: DataFrame, target: Target, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """``docs`` as struct ``doc`` with ``n_tokens``, ``weight`` (of its source), ``copies`` and ``places``.

    ``places`` holds ``epoch`` (from 0), ``block`` and ``place`` of each copy. All rows come back, those with no copy too. A null source is a source of its own; null
    and empty texts have no tokens. A source without any token is emitted once. Rows with
    equal key and text (repeated rows) share a place in a permutation and are taken or left
    together. An empty table gives an empty table.
    """
    slim, _ = written(
        docs.select(F.col(source).alias("source"), F.xxhash64(key, text).alias("key"), words(F.col(text)).alias("n_tokens")), "tokens"
    )
    sizes, _ = written(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    quotas, _ = written(weights(sizes, target), "weights")
    cuts, _ = written(_cuts(slim, quotas, seed), "cuts")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(key, text).alias("key"), words(F.col(text)).alias("n_tokens"))
    named = cuts.withColumnRenamed("source", "s")
    joined = rows.join(named, F.col(f"doc.{source}").eqNullSafe(F.col("s")))
    more = F.coalesce(_place(F.col("key"), F.col("epochs"), seed) <= F.col("cut"), F.lit(False))
    copies = F.col("epochs") + more.cast("long")
    epochs = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))

    def placed(epoch: Column) -> Column:
        place = _place(F.col("key"), epoch, seed)
        return F.struct(epoch.alias("epoch"), F.shiftright(place, 64 - BLOCK_BITS).alias("block"), place.alias("place"))

    return joined.select("doc", "n_tokens", "weight", "quota", "epochs", copies.alias("copies"), F.transform(epochs, placed).alias("places"))


def _cuts(slim: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """``quotas`` with ``cut``: the last place of the partial epoch whose tokens still fit."""
    named = quotas.select(F.col("source").alias("s"), "epochs", "rest")
    placed = (
        slim.join(named, F.col("source").eqNullSafe(F.col("s")))
        .where("rest > 0")
        .select("source", "rest", "n_tokens", _place(F.col("key"), F.col("epochs"), seed).alias("place"))
        .withColumn("block", F.shiftright("place", 64 - BLOCK_BITS))
    )
    by_block = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("place").alias("last"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = by_block.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    whole = blocks.where("before + tokens <= rest").groupBy("source").agg(F.max("last").alias("cut"))
    ends = blocks.where("before <= rest and before + tokens > rest").select(F.col("source").alias("s"), F.col("block").alias("b"), "before")
    within = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    inside = (
        placed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("sum", F.col("before") + F.sum("n_tokens").over(within))
        .where("sum <= rest")
        .groupBy("source")
        .agg(F.max("place").alias("cut"))
    )
    cut = whole.unionByName(inside).groupBy(F.col("source").alias("s")).agg(F.max("cut").alias("cut"))
    return quotas.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, target: Target, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mixture has them, columns unchanged."""
    return emitted(docs, target, key=key, text=text, source=source, seed=seed).select("doc.*")


def emitted(docs: DataFrame, target: Target, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """A row for each copy: struct ``doc`` with ``epoch``, ``block`` and ``place``; a source's order is by epoch and place."""
    planned = plan(docs, target, key=key, text=text, source=source, seed=seed)
    return planned.select("doc", F.explode("places").alias("at")).select("doc", "at.*")
