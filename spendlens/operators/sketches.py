"""Latency percentiles from mergeable sketches.

A KLL sketch (Karnin, Lang and Liberty, 2016) per group and day is small whatever the calls, and
sketches merge without loss of their guarantee, so percentiles over any stretch of days
come from stored sketches and not from the calls. A value read off a sketch has a rank within
``RANK_ERROR`` of the one asked for, with a probability above 99 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.operators.stats import KEYS, PERCENTILES

#: Size parameter of a sketch, and the error of a rank (as a share of the values) that goes with it.
SIZE = 1_024
RANK_ERROR = 0.01


def latency_sketches(calls: DataFrame, by: str = "provider") -> DataFrame:
    """A sketch of the latencies per group and UTC day: ``by``, ``day``, ``sketch``."""
    return (
        calls.where("latency_ms IS NOT NULL")
        .groupBy(F.expr(f"{KEYS[by]} AS {by}"), F.to_date("ts").alias("day"))
        .agg(F.kll_sketch_agg_bigint("latency_ms", SIZE).alias("sketch"))
    )


def merged(sketches: DataFrame, by: str = "provider") -> DataFrame:
    """One sketch per group of any sketches, also of appended days."""
    return sketches.groupBy(by).agg(F.kll_merge_agg_bigint("sketch", SIZE).alias("sketch"))


def percentiles(sketches: DataFrame, by: str = "provider") -> DataFrame:
    """Calls with a latency and its percentiles per group."""
    return merged(sketches, by).select(
        by,
        F.kll_sketch_get_n_bigint("sketch").alias("timed"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias(name) for name, p in PERCENTILES.items()],
    )


def within_error(read: DataFrame, calls: DataFrame, by: str = "provider", error: float = RANK_ERROR) -> DataFrame:
    """Adds ``<percentile>_ok``: whether its true rank among the calls is within ``error`` of the one asked for.

    A value holds all ranks from the share of smaller values to that of values up to it.
    """
    counted = calls.where("latency_ms IS NOT NULL").groupBy(F.expr(f"{KEYS[by]} AS {by}"), "latency_ms").agg(F.count("*").alias("n"))
    known = counted.join(read, by)
    shares = known.groupBy(by, "timed", *PERCENTILES).agg(
        F.sum("n").alias("all"),
        *[F.sum(F.when(F.col("latency_ms") < F.col(name), F.col("n")).otherwise(0)).alias(f"{name}_below") for name in PERCENTILES],
        *[F.sum(F.when(F.col("latency_ms") <= F.col(name), F.col("n")).otherwise(0)).alias(f"{name}_upto") for name in PERCENTILES],
    )
    good = [
        ((F.col(f"{name}_below") / F.col("all") <= p / 100 + error) & (F.col(f"{name}_upto") / F.col("all") >= p / 100 - error)).alias(f"{name}_ok")
        for name, p in PERCENTILES.items()
    ]
    return shares.select(by, "timed", *PERCENTILES, *good)
