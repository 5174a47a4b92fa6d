"""Near-duplicates by SimHash and a self-join of binary tries.

Fingerprints (64 bits, the majority of the shingles' hashes) are de-duplicated first. Two of
them within ``budget`` differing bits agree on at least ``4 - budget`` of their four 16-bit
blocks, so each choice of such blocks roots one forest: a trie for each value of the chosen
blocks over the remaining bits. In each trie pairs of nodes are traversed together from the
root pair, their differing bits are added up, and a pair is pruned when it exceeds the budget.
Forests together miss no link. Tries with very many leaves are first split into pairs of
subtrees (again pruned by budget), each pair a task of its own.

Of the leaf pairs found in a batch of tries, a spanning forest is kept: as many links as needed to
connect the same fingerprints, at most one for each leaf. Components follow by alternating
large-star and small-star steps on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import remove, runs_of, written

SHINGLE = 3
BUDGET = 2
SEED = 42
RUN_CHARS = 2_000_000
BLOCKS = 4
#: Leaves a trie may have before it is split into pairs of subtrees.
SPLIT_LEAVES = 20_000
#: Bits decided by one such split.
SPLIT_BITS = 8


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Of one text: bit set where more than half of the shingles' hashes have it."""
    return int(fingerprints([text], size)[0])


def fingerprints(texts: list[str], size: int = SHINGLE) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if len(words) <= size:
            hashes.append(digest(b" ".join(words), SEED))
            counts[at] = 1
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-size].tolist()]
        stops = (ends[size - 1 :] - 1).tolist()
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]
        counts[at] = len(stops)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    stop = np.cumsum(counts)
    for at in np.flatnonzero(counts):
        bits = np.unpackbits(octets[stop[at] - counts[at] : stop[at]], axis=1)
        high = bits.sum(0, dtype=np.int32) * 2 > counts[at]
        out[at] = np.packbits(high).view(">u8")[0]
    return out


def with_fingerprint(docs: DataFrame, *, text: str = "text", size: int = SHINGLE, out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a signed long; null and wordless texts have zero."""

    @F.pandas_udf("long")
    def simhash(batch: pd.Series) -> pd.Series:
        parts = [fingerprints(part, size) for _, part in runs_of(batch, RUN_CHARS)]
        return pd.Series(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return docs.withColumn(out, simhash(F.col(text)))


def trie_links(rest: np.ndarray, first: np.ndarray, second: np.ndarray | None, depth: int, budget: int):
    """Links in a batch of tries, as positions in ``rest``.

    ``rest`` holds the ``depth`` bits below the roots. ``first`` are the roots' ranges of
    leaves [from, to), each sorted by ``rest``; with ``second``, pairs of different roots
    are traversed, else each root with itself.
    """
    left, right = (first, first) if second is None else (first, second)
    spent = np.zeros(len(left), np.int64)
    for bit in range(depth - 1, -1, -1):
        if not len(left):
            break
        halves = []
        for node in (left, right):
            cut = _first_set(rest, node, bit)
            halves.append((np.stack([node[:, 0], cut], 1), np.stack([cut, node[:, 1]], 1)))
        (l0, l1), (r0, r1) = halves
        same = (left == right).all(1)
        pairs = [(l0, r0, spent), (l1, r1, spent), (l0, r1, spent + 1), (l1, r0, np.where(same, budget + 1, spent + 1))]
        left, right, spent = (np.concatenate(x) for x in zip(*pairs))
        alone = (left == right).all(1) & (left[:, 1] - left[:, 0] < 2)
        alive = (spent <= budget) & (left[:, 0] < left[:, 1]) & (right[:, 0] < right[:, 1]) & ~alone
        left, right, spent = left[alive], right[alive], spent[alive]
    return left[:, 0], right[:, 0]


def _first_set(rest: np.ndarray, node: np.ndarray, bit: int) -> np.ndarray:
    """Of each range: the first leaf whose ``bit`` is set (bits above it agree)."""
    low, high = node[:, 0].copy(), node[:, 1].copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        up = (rest[np.minimum(mid, len(rest) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
        high = np.where(open_ & up, mid, high)
        low = np.where(open_ & ~up, mid + 1, low)
    return low


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest leaf connected to each of ``n`` leaves."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root] != root).any():
            root = np.where(up, root[root], root)
    return root


def _forests(budget: int) -> list[tuple[int, ...]]:
    return list(combinations(range(BLOCKS), BLOCKS - budget))


def _block(value: Column, at: int) -> Column:
    return F.shiftrightunsigned(value, 48 - 16 * at).bitwiseAND(0xFFFF)


def _joined(value: Column, blocks: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("long")
    for at in blocks:
        out = F.shiftleft(out, 16).bitwiseOR(_block(value, at))
    return out


def _roots(prints: DataFrame, budget: int) -> DataFrame:
    """Each fingerprint in each forest: ``forest``, ``root``, ``rest``, ``fp``."""
    entries = []
    for nth, chosen in enumerate(_forests(budget)):
        others = tuple(x for x in range(BLOCKS) if x not in chosen)
        entries.append(
            F.struct(F.lit(nth).alias("forest"), _joined(F.col("fp"), chosen).alias("root"), _joined(F.col("fp"), others).alias("rest"))
        )
    return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.*", "fp")


def _split(leaves: DataFrame, keys: list[str], depth: int, budget: int) -> DataFrame:
    """Replaces a trie by its pairs of subtrees that the budget allows; ``side`` 0 or 1."""
    steps = [sum(1 << b for b in bits) for n in range(budget + 1) for bits in combinations(range(SPLIT_BITS), n)]
    node = F.shiftrightunsigned("rest", depth - SPLIT_BITS)
    other = node.bitwiseXOR(F.col("step").cast("long"))
    return (
        leaves.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
        .withColumn("low", F.least(node, other))
        .withColumn("high", F.greatest(node, other))
        .withColumn("side", (F.col("low") != node).cast("int"))
        .select(*keys, "low", "high", "side", "rest", "fp")
    )


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``a``, ``b``: links whose closure equals that of all pairs within ``budget`` bits.

    ``prints`` has distinct fingerprints in column ``fp``.
    """
    depth = 16 * budget
    roots, path = written(_roots(prints, budget), "tries")
    sizes = roots.groupBy("forest", "root").count().where("count > 1")
    few = sizes.where(F.col("count") <= SPLIT_LEAVES).select("forest", "root")
    many = sizes.where(F.col("count") > SPLIT_LEAVES).select("forest", "root")
    whole = roots.join(few, ["forest", "root"])
    out = _linked(whole.withColumn("side", F.lit(0)), ["forest", "root"], budget)
    if not many.isEmpty():
        pairs = _split(roots.join(many, ["forest", "root"]), ["forest", "root"], depth, budget)
        out = out.unionByName(_linked(pairs, ["forest", "root", "low", "high"], budget))
    found, _ = written(out, "links")
    remove(prints.sparkSession, path)
    return found


def _linked(leaves: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Traverses the tries named by ``keys``; rows of both sides of a pair share them."""
    depth = 16 * budget

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names = batch[keys].to_numpy()
            whole = int(np.flatnonzero((names != names[-1]).any(1))[-1] + 1) if len(batch) and (names != names[-1]).any() else 0
            held = batch.iloc[whole:].reset_index(drop=True)
            if whole:
                yield found(batch.iloc[:whole])
        if held is not None and len(held):
            yield found(held)

    def found(batch: pd.DataFrame) -> pd.DataFrame:
        names, side = batch[keys].to_numpy(), batch["side"].to_numpy()
        rest, fp = batch["rest"].to_numpy().view(np.uint64), batch["fp"].to_numpy()
        new = np.r_[True, (names[1:] != names[:-1]).any(1)]
        edge = np.r_[True, new[1:] | (side[1:] != side[:-1])]
        at = np.flatnonzero(edge)
        node = np.stack([at, np.r_[at[1:], len(rest)]], 1)
        two = np.r_[~new[at][1:], False]  # the next range is this pair's other side
        if "low" in keys:
            same = (batch["low"] == batch["high"]).to_numpy()[at]
            a, b = trie_links(rest, node[same], None, depth, budget)
            c, d = trie_links(rest, node[:-1][two[:-1]], node[1:][two[:-1]], depth, budget)
            a, b = np.r_[a, c], np.r_[b, d]
        else:
            a, b = trie_links(rest, node, None, depth, budget)
        root = spanning(a, b, len(rest))
        linked = np.flatnonzero(root != np.arange(len(rest)))
        return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})

    columns = [*keys, "side", "rest", "fp"]
    return (
        leaves.select(*columns)
        .repartition(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys, "side", "rest")
        .mapInPandas(traverse, "a long, b long")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (the smallest connected node) for each node with an edge.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until the edges no
    longer change. A hub's neighbours are never gathered: only its smallest one is, by a
    partial aggregation. A table per round, the one before is removed.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def star(pairs: DataFrame, centre: Column) -> DataFrame:
        """Links the far ends of ``u``'s neighbours ``v`` to the smallest of them and ``u``."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(low, "u").where(centre).select(F.col("v").alias("a"), F.col("m").alias("b"))

    def mark(table: DataFrame) -> tuple:
        return tuple(table.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = star(both, F.col("v") > F.col("u")).where("a <> b")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        after, new_path = written(small.where("a <> b").distinct(), "edges")
        remove(spark, path)
        now, path = after, new_path
        if (this := mark(now)) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = this
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``key``, ``fingerprint`` (long) and ``component_id`` of every row.

    ``component_id`` is the smallest key among the rows reachable over links of at most
    ``budget`` bits (1 to 3), the row itself included. Null and wordless texts have
    fingerprint zero and link like others; a null key is never the smallest, unless all
    keys of a component are null. Repeated rows come back repeated; other columns are not
    read. An empty table gives an empty table.
    """
    rows, _ = written(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), size=size, out="fp").drop("text"), "prints")
    prints, _ = written(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct-prints")
    found = components(links(prints.select("fp"), budget))
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(label, "fp").select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, columns unchanged: the one with the smallest key (a null key
    after all others), then fingerprint, then row number. Neither null nor repeated keys keep more.
    """
    store, _ = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    found = near_duplicates(store.select("row", F.col(f"doc.{text}").alias("text")), key="row", text="text")
    value = F.col(f"doc.{key}")
    keyed = store.select(F.col("row").alias("r"), value.isNull().alias("last"), value.alias("key"))
    placed = found.join(keyed, F.col("row") == F.col("r"))
    best = placed.groupBy("component_id").agg(F.min(F.struct("last", "key", "fingerprint", "row")).alias("best"))
    stay = best.select(F.col("best.row").alias("_stays"))
    return store.join(stay, F.col("row") == F.col("_stays"), "left_semi").select("doc.*")
