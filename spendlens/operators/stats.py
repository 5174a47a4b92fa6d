"""Grouped statistics, and the report of calls without a price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import join_parts, micro_part, rest_part, usd
from spendlens.operators.pricing import RateCard, price_calls

PERCENTILES = {"p50_ms": 50, "p95_ms": 95}


KEYS = {
    "provider": "provider",
    "model": "coalesce(model, 'unknown')",
    "client": "coalesce(client, 'unknown')",
    "day": "date_format(ts, 'yyyy-MM-dd')",
    "exe": "coalesce(peer_exe, 'unknown')",
}

IS_ERROR = "(error_kind IS NOT NULL OR coalesce(status, 0) >= 400)"

# Prompt tokens the cache reads are compared with. A model without a price counts
# as one whose cache reads are part of its input.
CACHE_DENOMINATOR = """CASE WHEN coalesce(cache_in_input, true) THEN coalesce(input_tokens, 0)
    ELSE try_add(try_add(coalesce(input_tokens, 0), coalesce(cache_read_input_tokens, 0)),
        coalesce(cache_creation_input_tokens, 0)) END"""


def cache_pct(read: str, denominator: str) -> str:
    return f"CASE WHEN {denominator} > 0 AND {read} > 0 THEN {read} * 100.0D / {denominator} END"


def _measures(priced: DataFrame, by: str) -> DataFrame:
    if by not in KEYS:
        raise ValueError(f"unknown grouping {by!r}; expected one of {sorted(KEYS)}")
    return priced.select(
        F.expr(f"{KEYS[by]} AS {by}"),
        "latency_ms",
        F.expr("coalesce(input_tokens, 0) AS input"),
        F.expr("coalesce(output_tokens, 0) AS output"),
        F.expr("coalesce(cache_read_input_tokens, 0) AS cache_read"),
        F.expr("coalesce(cache_creation_input_tokens, 0) AS cache_write"),
        F.expr(f"{CACHE_DENOMINATOR} AS cache_denom"),
        F.expr(f"{IS_ERROR} AS is_error"),
        micro_part(F.col("cost_pico")).alias("micro"),
        rest_part(F.col("cost_pico")).alias("rest"),
    )


_SUMMED = ["input", "output", "cache_read", "cache_write", "cache_denom", "micro", "rest"]


def _report(totals: DataFrame, by: str) -> DataFrame:
    return totals.select(
        by,
        "calls",
        F.col("input").alias("input_tokens"),
        F.col("output").alias("output_tokens"),
        F.col("cache_read").alias("cache_read_tokens"),
        F.col("cache_write").alias("cache_creation_tokens"),
        F.expr(f"{cache_pct('cache_read', 'cache_denom')} AS cache_hit_pct"),
        "errors",
        *PERCENTILES,
        usd(join_parts(F.col("micro"), F.col("rest"))).alias("cost_usd"),
        "unpriced_calls",
    ).orderBy(by)


def grouped_stats(
    calls: DataFrame, prices: DataFrame | RateCard, by: str = "provider", exact: bool = True
) -> DataFrame:
    """Calls, tokens, cache hits, errors, latency percentiles and cost per group, by key.

    The percentiles are exact nearest-rank ones. The calls are first summed per
    (group, latency in ms), which spreads even a dominating group over all
    tasks; the ranks are then read off that histogram, whose size per group is
    the number of distinct latencies. ``exact=False`` takes approximate ones
    and saves the histogram.
    """
    measures = _measures(price_calls(calls, prices), by)
    # A total beyond BIGINT is unknown.
    sums = [f"try_sum({c}) AS {c}" for c in _SUMMED]
    counts = [
        "count(*) AS calls",
        "count_if(is_error) AS errors",
        "count(*) - count(micro) AS unpriced_calls",
    ]
    if not exact:
        ranks = [
            f"percentile_approx(latency_ms, {p / 100}, 10000) AS {name}"
            for name, p in PERCENTILES.items()
        ]
        return _report(measures.groupBy(by).agg(*map(F.expr, counts + sums + ranks)), by)

    histogram = measures.groupBy(by, "latency_ms").agg(
        *map(F.expr, [*counts, "count(latency_ms) AS timed", *sums])
    )
    ranked = histogram.selectExpr(
        "*",
        f"""sum(timed) OVER (PARTITION BY {by} ORDER BY latency_ms
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to""",
        f"sum(timed) OVER (PARTITION BY {by}) AS all_timed",
    )
    ranks = [
        f"min(CASE WHEN up_to * 100 >= all_timed * {p} THEN latency_ms END) AS {name}"
        for name, p in PERCENTILES.items()
    ]
    resummed = [f"sum({c}) AS {c}" for c in ("calls", "errors", "unpriced_calls")]
    return _report(ranked.groupBy(by).agg(*map(F.expr, resummed + sums + ranks)), by)


def unpriced_models(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Calls with tokens but no price, per model, most frequent first."""
    return (
        price_calls(calls, prices)
        .where(F.col("cost_pico").isNull())
        .groupBy(F.coalesce("model", F.lit("unknown")).alias("model"))
        .agg(F.count("*").alias("calls"))
        .orderBy(F.desc("calls"), "model")
    )


def top_unpriced_models(calls: DataFrame, prices: DataFrame | RateCard, n: int = 3) -> DataFrame:
    return unpriced_models(calls, prices).limit(n)


def unpriced_summary(calls: DataFrame, prices: DataFrame | RateCard, age_days: int | None = None) -> DataFrame:
    """One row: all calls with tokens but no price, their most frequent models, and the age of the table.

    No row when every call has a price. ``age_days`` is None where there is no price table.
    """
    unpriced = unpriced_models(calls, prices)
    total = unpriced.agg(F.sum("calls").alias("total")).selectExpr("total", "CAST(NULL AS STRUCT<n: BIGINT, model: STRING>) AS top")
    few = unpriced.limit(3).selectExpr("CAST(NULL AS BIGINT) AS total", "named_struct('n', -calls, 'model', model) AS top")
    both = total.unionByName(few).agg(F.max("total").alias("unpriced_calls"), F.array_sort(F.collect_list("top")).alias("tops"))
    names = "array_join(transform(tops, m -> m.model || ' (' || -m.n || ')'), ', ') AS top"
    age = "no price table found" if age_days is None else "price table pulled today" if age_days == 0 else f"price table is {age_days} days old"
    return both.where("unpriced_calls > 0").select("unpriced_calls", F.expr(names), F.lit(age).alias("age"))


def with_formats(report: DataFrame) -> DataFrame:
    """Add the texts a table of statistics shows: whole percent or ``-``, cost to 4 decimals."""
    return report.selectExpr(
        "*",
        """coalesce(CAST(CAST(cache_hit_pct AS DECIMAL(24,0)) AS STRING) || '%', '-')
            AS cache_pct""",
        "CAST(CAST(cost_usd AS DECIMAL(24,4)) AS STRING) AS cost",
    )
