"""Removal of repeated runs of lines, with DataFrame functions only.

Lines become ids: the rank of their 128-bit hash among lines that occur more than once (a line
that occurs once ends every repeated run). Suffixes of documents, as sequences of line ids,
are ranked by distributed prefix doubling: with ranks by the first ``w`` lines known, the pair of
ranks at ``i`` and ``i + s`` (``s`` up to ``w``) ranks by the first ``w + s``. Sorted by rank the
suffixes are the suffix array to that depth; suffixes of equal rank are an interval whose
longest common prefix is at least the depth. Suffixes alone in their interval leave the table,
and doubling goes on until none is left, so each suffix is known with the deepest interval that
has an earlier suffix than it.

A window of lines that has an earlier copy (by key, then row, then line) goes when it has at least
``min_lines`` lines, or more than ``min_words`` words, or is a whole document. Depth grows by
one line up to ``min_lines``, so that windows are told at every length where words decide, and
doubles from there. What goes is joined to maximal runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import maybe_among, remove, written

MIN_LINES = 3
MIN_WORDS = 50
#: Intervals with more than this share of all suffixes are met by broadcast; there are at most so many.
HOT = 4_096
#: Ranks are summed in slices of so many (as a power of two), then over the slices.
SLICE = 16


def line_ranks(lines: DataFrame) -> DataFrame:
    """The lines that occur more than once, with ``r`` for their hash.

    ``r`` orders lines by hash. Lines are counted before they are ranked, and ranked in
    two steps: sums over slices of the hashes, then within a slice.
    """
    classes = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    classes = classes.withColumn("slice", F.shiftright("h1", 48))
    slices = classes.groupBy("slice").agg(F.sum("n").alias("n")).withColumn("page", F.shiftright("slice", 8))
    pages = slices.groupBy("page").agg(F.sum("n").alias("n"))

    def before(*by: str):
        window = Window.partitionBy(*by[:-1]) if by[:-1] else Window.partitionBy(F.lit(0))
        return window.orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)

    def upto(window) -> F.Column:
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    pages = pages.select("page", upto(before("page")).alias("base"))  # 256 rows at most
    slices = slices.join(pages, "page").select("slice", (F.col("base") + upto(before("page", "slice"))).alias("base"))
    within = Window.partitionBy("slice").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    ranks = classes.withColumn("own", upto(within)).join(slices, "slice").select("h1", "h2", (F.col("base") + F.col("own")).alias("r"))
    ranks, _ = written(ranks, "line-ranks")
    likely = maybe_among(lines, F.col("h1"), ranks, F.col("h1"), out="likely").where("likely")
    return likely.join(ranks, ["h1", "h2"]).select("uid", "i", "key", "n_lines", "own", F.col("own").alias("words"), "r")


def deeper(ranked: DataFrame, step: int) -> DataFrame:
    """Ranks by ``step`` more lines than before, of suffixes that still share theirs.

    A rank counts the suffixes before its interval; below one old rank they are summed in slices of the
    second rank, then over the slices, so a line that many others follow is not one task.
    """
    at = Window.partitionBy("uid").orderBy("i").rangeBetween(step, step)
    pairs = ranked.withColumn("r2", F.first("r").over(at)).withColumn("words", F.col("own") + F.first("words").over(at))
    pairs = pairs.where("r2 is not null")
    place = F.struct("key", "uid", "i")
    classes = pairs.groupBy("r", "r2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    classes = classes.withColumn("slice", F.shiftright("r2", SLICE))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda window: F.coalesce(F.sum("n").over(window), F.lit(0))
    slices = classes.groupBy("r", "slice").agg(F.sum("n").alias("n"))
    bases = slices.select("r", "slice", summed(before("r", "slice")).alias("base"))
    ranks = classes.withColumn("own_base", summed(before("r", "slice", "r2"))).join(bases, ["r", "slice"])
    ranks = ranks.select("r", "r2", "first", (F.col("r") + F.col("base") + F.col("own_base")).alias("to"))
    later = (place != F.col("first")).alias("later")
    return pairs.join(ranks, ["r", "r2"]).select("uid", "i", "key", "n_lines", "own", "words", later, F.col("to").alias("r"))


def with_later(ranked: DataFrame) -> DataFrame:
    """Adds ``later``: whether a suffix is not the first of its interval."""
    place = F.struct("key", "uid", "i")
    share = ranked.count() // HOT
    firsts = ranked.groupBy("r").agg(F.min(place).alias("first"), F.count("*").alias("n")).withColumnRenamed("r", "interval")
    hot = F.broadcast(firsts.where(F.col("n") > share).select("interval", "first"))  # at most HOT rows
    marked = ranked.join(hot, F.col("r") == F.col("interval"), "left").drop("interval")
    usual = marked.where("first is null").drop("first").join(
        firsts.where(F.col("n") <= share).select("interval", "first"), F.col("r") == F.col("interval")
    )
    both = marked.where("first is not null").unionByName(usual.drop("interval"))
    return both.withColumn("later", place != F.col("first")).drop("first")


def later_copies(lines: DataFrame, min_lines: int, min_words: int) -> tuple[DataFrame, list[str]]:
    """``uid``, ``i`` and ``length``: windows with an earlier copy that go; and the tables they are read from."""
    spark = lines.sparkSession
    plain, plain_path = written(line_ranks(lines), "ranks")
    ranked, path = written(with_later(plain), "ranks")
    remove(spark, plain_path)
    depth, found, paths = 1, [], [path]
    while True:
        goes = F.lit(True) if depth >= min_lines else (F.col("words") > min_words) | (F.col("n_lines") == depth)
        found.append(ranked.where(F.col("later") & goes).select("uid", "i", F.lit(depth).alias("length")))
        if ranked.isEmpty():
            return reduce(DataFrame.unionByName, found), paths
        step = 1 if depth < min_lines else depth
        ranked, path = written(deeper(ranked, step), "ranks")
        paths.append(path)
        depth += step


def _runs(windows: DataFrame) -> DataFrame:
    """``u`` and ``runs``: the windows of each document, joined where they touch."""
    order = Window.partitionBy("uid").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    longest = windows.groupBy("uid", "i").agg((F.col("i") + F.max("length")).alias("end"))
    opened = longest.withColumn("reach", F.max("end").over(before)).withColumn(
        "run", F.sum(F.when(F.col("reach") >= F.col("i"), 0).otherwise(1)).over(order)
    )
    runs = opened.groupBy("uid", "run").agg(F.min("i").alias("from"), F.max("end").alias("to"))
    return runs.groupBy(F.col("uid").alias("u")).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))


def remove_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS
) -> DataFrame:
    """Every row as struct ``doc`` with ``n_lines``, ``n_removed``, ``runs`` and ``kept``.

    Lines are what stands between line feeds; a null text has none, an empty one has one
    empty line. ``runs`` are the maximal removed [from, to) in lines, ``kept`` the other
    lines joined by line feeds (null for null texts). Of repeated rows the first stays. A null
    key sorts first. Columns of any name are safe inside ``doc``; an empty table gives an
    empty table.
    """
    store, _ = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("doc")), "lines")
    body = F.split(F.col(f"doc.{text}"), "\n", -1)
    exploded = store.select(
        "uid", F.col(f"doc.{key}").alias("key"), F.size(body).alias("n_lines"), F.posexplode(body).alias("i", "line")
    )
    hashed = exploded.select(
        "uid", "i", "key", "n_lines",
        F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("own"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
    )
    copies, paths = later_copies(hashed, min_lines, min_words)
    spans, _ = written(_runs(copies), "runs")
    remove(docs.sparkSession, *paths)
    marked = maybe_among(store, F.col("uid"), spans, F.col("u"), out="marked")
    # The runs grow with the input: never broadcast, however few they look.
    some = marked.where("marked").join(spans.hint("merge"), F.col("uid") == F.col("u"), "left").select("doc", "runs")
    rest = marked.where("not marked").select("doc", F.lit(None).cast(spans.schema["runs"].dataType).alias("runs"))
    # What stays: the stretches between the runs.
    own = F.col("lines")
    edge = F.struct(F.size(own).alias("from"), F.size(own).alias("to"))
    stay = F.flatten(
        F.transform(
            F.concat("runs", F.array(edge)),
            lambda run, j: F.slice(
                own,
                F.when(j == 0, 0).otherwise(F.col("runs")[F.greatest(j - 1, F.lit(0))].to) + 1,
                run["from"] - F.when(j == 0, 0).otherwise(F.col("runs")[F.greatest(j - 1, F.lit(0))].to),
            ),
        )
    )
    removed = F.aggregate("runs", F.lit(0), lambda n, run: n + run.to - run["from"])
    none = F.array().cast(spans.schema["runs"].dataType)
    both = some.unionByName(rest).withColumn("runs", F.coalesce("runs", none)).withColumn("lines", F.split(F.col(f"doc.{text}"), "\n", -1))
    return both.select(
        "doc",
        F.when(own.isNull(), 0).otherwise(F.size(own)).alias("n_lines"),
        removed.alias("n_removed"),
        "runs",
        F.when(own.isNull(), F.lit(None)).when(F.size("runs") == 0, F.col(f"doc.{text}")).otherwise(F.array_join(stay, "\n")).alias("kept"),
    )
