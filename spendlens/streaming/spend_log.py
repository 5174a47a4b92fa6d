"""Running spend of a stream, kept as a log of changes.

Each micro-batch prices its calls, sums them by period and provider, adds what the log knew of these
keys, and writes the changed rows only, in a folder named by the batch. A batch that is run
again reads the batches before it and replaces its own folder, so nothing counts twice.
A reader takes the newest row of each key from the folders that are complete, so it always sees the
state after some batch. Now and then the batches before the running one become one base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlens.functions.money import join_parts, micro_part, rest_part, usd
from spendlens.operators.budget import verdict
from spendlens.operators.pricing import RateCard, price_calls, rate_card

KEYS = ["period", "provider"]
SUMS = ["calls", "unpriced_calls", "micro", "rest"]
STATE = "period timestamp, provider string, calls bigint, unpriced_calls bigint, micro bigint, rest bigint, batch bigint"
#: Complete folders of batches after which they become one.
COMPACT_AFTER = 16


def totals(calls: DataFrame, prices: DataFrame | RateCard, period: str = "day") -> DataFrame:
    """Calls, calls of unknown cost and known spend by UTC ``period`` (day or hour) and provider."""
    priced = price_calls(calls, prices)
    return priced.groupBy(F.date_trunc(period, F.col("ts").cast("timestamp")).alias("period"), "provider").agg(
        F.count("*").alias("calls"),
        F.expr("count(*) - count(cost_pico) AS unpriced_calls"),
        F.coalesce(F.sum(micro_part(F.col("cost_pico"))), F.lit(0)).alias("micro"),
        F.coalesce(F.sum(rest_part(F.col("cost_pico"))), F.lit(0)).alias("rest"),
    )


def _folders(spark: SparkSession, path: str) -> dict[str, dict[int, str]]:
    """The complete folders: by kind (``base``, ``batch``) and number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"base": {}, "batch": {}}
    if files.exists(root):
        for entry in files.listStatus(root):
            kind, _, number = entry.getPath().getName().partition("-")
            folder = entry.getPath().toString()
            if kind in found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
                found[kind][int(number)] = folder
    return found


def _state(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, list[str]]:
    """The newest row of each key, of the batches ``before`` one, and the folders read for it."""
    folders = _folders(spark, path)
    bases = {n: f for n, f in folders["base"].items() if before is None or n < before}
    base = max(bases, default=-1)
    read = [bases[base]] if bases else []
    read += [f for n, f in sorted(folders["batch"].items()) if n > base and (before is None or n < before)]
    if not read:
        return spark.createDataFrame([], STATE), []
    log = spark.read.schema(STATE).parquet(*read)
    newest = log.groupBy(*KEYS).agg(F.max_by(F.struct(*SUMS, "batch"), "batch").alias("s"))
    return newest.select(*KEYS, "s.*"), read


def _compact(spark: SparkSession, path: str, batch_id: int) -> None:
    """Makes one base of the batches before ``batch_id``, which no longer run, and removes them."""
    state, read = _state(spark, path, before=batch_id)
    if len(read) >= COMPACT_AFTER:
        state.write.mode("overwrite").parquet(f"{path}/base-{batch_id - 1}")
        for folder in read:
            old = spark._jvm.org.apache.hadoop.fs.Path(folder)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def fold(batch: DataFrame, batch_id: int, prices: DataFrame | RateCard, path: str, period: str = "day") -> None:
    """Add the calls of one batch to the log. Doing it again changes nothing."""
    spark = batch.sparkSession
    _compact(spark, path, batch_id)
    before, _ = _state(spark, path, before=batch_id)
    known = before.toDF(*[f"old_{c}" for c in before.columns])
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in KEYS]
    changed = totals(batch, prices, period).join(known, same[0] & same[1], "left").select(
        *KEYS,
        *[(F.col(c) + F.coalesce(f"old_{c}", F.lit(0))).alias(c) for c in SUMS],
        F.lit(batch_id).cast("bigint").alias("batch"),
    )
    changed.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")


def keep_spend(
    calls: DataFrame, prices: DataFrame | RateCard, path: str, checkpoint: str, period: str = "day", **trigger
) -> StreamingQuery:
    """Keep the spend of a stream of calls by ``period`` and provider in the log at ``path``."""
    card = rate_card(prices)
    return (
        calls.writeStream.foreachBatch(lambda batch, batch_id: fold(batch, batch_id, card, path, period))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _spent(micro: str, rest: str):
    return usd(join_parts(F.col(micro), F.col(rest)))


def read_spend(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last complete batch: one row per period and provider."""
    state, _ = _state(spark, path)
    return state.select(*KEYS, "calls", "unpriced_calls", "micro", "rest", _spent("micro", "rest").alias("spent"))


def budget_by_day(spend: DataFrame, budget: float) -> DataFrame:
    """The verdict of each day and provider of a daily spend on a daily budget."""
    days = spend.withColumn("day", F.date_format("period", "yyyy-MM-dd"))
    return verdict(days.select("day", "provider", "calls", "unpriced_calls", "spent"), budget)


def rolling_budget(spend: DataFrame, budget: float, hours: int) -> DataFrame:
    """At each hour with calls: the spend of the ``hours`` up to its end, and the verdict on the budget.

    ``spend`` is an hourly one. What is ordered per provider is a row per hour, not the calls.
    """
    span = f"PARTITION BY provider ORDER BY period RANGE BETWEEN INTERVAL '{hours - 1}' HOUR PRECEDING AND CURRENT ROW"
    windows = spend.selectExpr(
        "period AS hour",
        "provider",
        f"sum(calls) OVER ({span}) AS calls",
        f"sum(unpriced_calls) OVER ({span}) AS unpriced_calls",
        f"sum(micro) OVER ({span}) AS micro",
        f"sum(rest) OVER ({span}) AS rest",
    )
    return verdict(windows.withColumn("spent", _spent("micro", "rest")).drop("micro", "rest"), budget)
