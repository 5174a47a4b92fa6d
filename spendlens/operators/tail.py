"""Listing of the most recent calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import reported_pico, usd_decimal
from spendlens.functions.text import error_label, short_client, status_label, tokens_label
from spendlens.operators.pricing import RateCard, price_calls, with_cost_source

DEFAULT_ROWS = 20

LISTED = {
    "ts": "ts",
    "provider": "provider",
    "model": "model",
    "endpoint": "endpoint",
    "status": "status",
    "latency_ms": "latency_ms",
    "ttft_ms": "ttft_ms",
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_read_input_tokens": "cache_read_tokens",
    "cache_creation_input_tokens": "cache_creation_tokens",
    "cost_usd": "cost_usd",
    "cost_source": "cost_source",
    "error_kind": "error_kind",
    "anomaly": "anomaly",
    "client": "client",
}


def newest(calls: DataFrame, n: int = DEFAULT_ROWS, order: str = "ingest_seq") -> DataFrame:
    """The ``n`` calls inserted last, in order of insertion."""
    return calls.orderBy(F.desc(order)).limit(n).orderBy(order)


def priced_listing(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """Calls with cost and its source under the names of the listing."""
    priced = with_cost_source(price_calls(calls, prices))
    extra = [c for c in calls.columns if c not in LISTED and c == "ingest_seq"]
    return priced.select(*extra, *[F.col(c).alias(name) for c, name in LISTED.items()])


def tail(
    calls: DataFrame,
    prices: DataFrame | RateCard,
    n: int = DEFAULT_ROWS,
    order: str = "ingest_seq",
) -> DataFrame:
    """The last ``n`` calls by insertion, oldest first; only those are priced."""
    last = newest(calls, n, order)
    return priced_listing(last, prices).orderBy(order)


def with_labels(listing: DataFrame) -> DataFrame:
    """Add the texts a listing shows for status, tokens, cache, cost, error and client."""
    tokens = tokens_label(F.col("input_tokens"), F.col("output_tokens"))
    return listing.select(
        "*",
        status_label(F.col("status")).alias("status_label"),
        tokens.alias("tokens_label"),
        F.expr(
            """CASE WHEN cache_read_tokens > 0
               THEN 'cache_read=' || CAST(cache_read_tokens AS STRING) END AS cache_label"""
        ),
        F.concat(
            F.lit("$"), usd_decimal(reported_pico(F.col("cost_usd")), 4).cast("string")
        ).alias("cost_label"),
        error_label(F.col("error_kind"), F.col("status")).alias("error_label"),
        short_client(F.col("client")).alias("client_label"),
    )


def lines(listing: DataFrame) -> DataFrame:
    """One line of text per call of a listing."""
    shown = with_labels(listing)
    keep = [c for c in listing.columns if c == "ingest_seq"]
    return shown.select(
        *keep,
        F.expr(
            """'[' || replace(CAST(ts AS STRING), ' ', 'T') || 'Z' || '] ' || provider || ' '
            || coalesce(model, '?') || ' ' || status_label || ' ' || CAST(latency_ms AS STRING)
            || 'ms tokens=' || tokens_label
            || coalesce(' ' || cache_label, '') || coalesce(' ' || cost_label, '')
            || coalesce(' ERROR=' || error_label, '') || coalesce(' ANOMALY=' || anomaly, '')
            || coalesce(' client=' || client_label, '') AS line"""
        ),
    )
