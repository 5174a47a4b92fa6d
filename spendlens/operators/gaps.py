"""Idle time between calls, without putting a whole provider into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Idle-gap buckets, upper bounds in seconds.
GAP_BUCKETS = [("<30s", 30), ("30s-5m", 300), ("5-15m", 900), ("15-60m", 3600)]
LAST_BUCKET = ">1h"

SLICE_SECONDS = 60


def gap_bucket(gap: str) -> str:
    whens = " ".join(f"WHEN {gap} < {upto} THEN '{name}'" for name, upto in GAP_BUCKETS)
    return f"CASE {whens} ELSE '{LAST_BUCKET}' END"


def with_previous(
    rows: DataFrame, by: str = "provider", tie: str = "id", slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Add ``previous_ts``: the time of the row before, per ``by``, in order of (ts, tie).

    A window over ``by`` alone would send a dominating group to one task. The
    rows are windowed per group and slice of time instead, and the first row of
    a slice takes the last time of the slice before it, from a table with one
    row per group and non-empty slice. Both are partitioned alike, so the rows
    are shuffled once.
    """
    sliced = rows.selectExpr(
        "*",
        f"coalesce('=' || {by}, '') AS _group",
        f"CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / {slice_seconds}) AS BIGINT) AS _slice",
    )
    edges = (
        sliced.groupBy("_group", "_slice")
        .agg(F.max("ts").alias("_last"))
        .selectExpr(
            "_group",
            "_slice",
            "lag(_last) OVER (PARTITION BY _group ORDER BY _slice) AS _before",
        )
    )
    windowed = sliced.withColumn(
        "_within", F.expr(f"lag(ts) OVER (PARTITION BY _group, _slice ORDER BY ts, {tie})")
    )
    return windowed.join(edges, ["_group", "_slice"], "left").select(
        *[windowed[c] for c in rows.columns], F.coalesce("_within", "_before").alias("previous_ts")
    )


def idle_gaps(calls: DataFrame, by: str = "provider") -> DataFrame:
    """Calls with input tokens and the seconds since the provider's call before, first ones dropped."""
    active = with_previous(calls.where("input_tokens > 0"), by)
    return (
        active.where("previous_ts IS NOT NULL")
        .withColumn("gap_s", F.expr("timestampdiff(MICROSECOND, previous_ts, ts) / 1000000.0D"))
        .withColumn("gap_bucket", F.expr(gap_bucket("gap_s")))
    )
