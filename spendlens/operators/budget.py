"""Spend in a time window, and its verdict against a budget."""

from __future__ import annotations

import math
from datetime import datetime, tzinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import pico_total, usd
from spendlens.operators.pricing import RateCard, price_calls
from spendlens.timebounds import from_bound, window_bound


def parse_budget(spec: str) -> tuple[float, str]:
    """``50``, ``50/day`` or ``300/7d`` -> (USD, period); the period defaults to ``day``."""
    amount, slash, period = (part.strip() for part in spec.partition("/"))
    if not slash:
        period = "day"
    if not period:
        raise ValueError(f"budget period is empty in {spec!r}")
    try:
        budget = float(amount) if "_" not in amount else math.nan
    except ValueError as e:
        raise ValueError(f"bad budget amount {amount!r}") from e
    if not math.isfinite(budget) or budget <= 0:
        raise ValueError(f"budget must be a positive number, got {amount!r}")
    return budget, period


def period_hours(period: str) -> int:
    """The length of a rolling period (``36h``, ``7d``, ``day``, ``week``) in hours of elapsed time."""
    named = {"day": 24, "week": 168}
    if period in named:
        return named[period]
    count, unit = period[:-1], period[-1:]
    if unit not in ("h", "d") or not count.isdigit() or int(count) < 1:
        raise ValueError(f"a rolling period is given in hours or days, not {period!r}")
    return int(count) * (24 if unit == "d" else 1)


def spend(calls: DataFrame, prices: DataFrame | RateCard) -> DataFrame:
    """One row: known spend in USD, and the number of calls whose cost is unknown."""
    return price_calls(calls, prices).agg(
        usd(pico_total(F.col("cost_pico"))).alias("spent"),
        F.expr("count(*) - count(cost_pico) AS unpriced_calls"),
    )


def verdict(spent: DataFrame, budget: float) -> DataFrame:
    """Add the verdict on a budget to ``spent`` and ``unpriced_calls``.

    Spend equal to the budget is over it. Known spend over the budget decides
    even when other calls have no price; under it, such calls leave the
    ``status`` unknown.
    """
    return spent.withColumn("budget", F.lit(budget)).selectExpr(
        "*",
        "spent / budget * 100.0D AS pct",
        "spent >= budget AS over",
        "budget - spent AS remaining",
        """CASE WHEN spent >= budget THEN 'over' WHEN unpriced_calls > 0 THEN 'unknown'
            ELSE 'ok' END AS status""",
    )


def budget_check(
    calls: DataFrame,
    prices: DataFrame | RateCard,
    spec: str,
    now: datetime,
    tz: str | tzinfo = "UTC",
) -> DataFrame:
    """The verdict for a budget text such as ``50/day`` at ``now``, as one row."""
    budget, period = parse_budget(spec)
    bound = window_bound(period, now, tz)
    checked = verdict(spend(from_bound(calls, bound), prices), budget)
    return checked.select(
        F.lit(period).alias("window"),
        F.lit(bound.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("since"),
        "spent",
        "budget",
        "pct",
        "over",
        "remaining",
        "unpriced_calls",
        "status",
    )


def budget_line(checked: DataFrame) -> DataFrame:
    """The verdict as one line of text: ``day: $14.20 / $50.00 (28%) — ok``.

    A verdict that calls without a price leave open reads ``unknown (143 unpriced)``.
    """

    def rounded(value: str, scale: int) -> str:
        return f"CAST(CAST({value} AS DECIMAL(24,{scale})) AS STRING)"

    return checked.selectExpr(
        f"""window || ': $' || {rounded('spent', 2)} || ' / $' || {rounded('budget', 2)}
        || ' (' || {rounded('pct', 0)} || '%) — '
        || CASE WHEN over THEN 'OVER by $' || {rounded('-remaining', 2)}
            WHEN status = 'unknown' THEN 'unknown (' || unpriced_calls || ' unpriced)'
            ELSE 'ok' END AS line"""
    )
