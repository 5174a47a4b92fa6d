"""Exact money on integers.

A rate in USD per million tokens has at most six decimals, so rate x 1e6 is a
whole number of pico-USD (1e-12 USD) per token and the price of a call is a
BIGINT. Integer sums do not depend on the order of the rows, stay in the
vectorised hash aggregate and never lose digits; doubles appear only at the
edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PICO_PER_USD = 1e12


def reported_pico(cost_usd: Column) -> Column:
    """A provider-reported USD amount in pico-USD; NULL beyond 9.2 million USD, and for no number."""
    pico = cost_usd * F.lit(PICO_PER_USD) + F.lit(0.5)
    return F.when(F.abs(pico) < F.lit(2.0**63), F.floor(pico).cast("bigint"))


def usd(pico: Column) -> Column:
    return pico.cast("double") / F.lit(PICO_PER_USD)


def pico_total(pico: Column) -> Column:
    """Sum as DECIMAL(38,0); NULLs (unknown prices) are left out.

    Whole micro-USD and the remainder are summed apart: each sum is a BIGINT
    good for trillions of USD, where one BIGINT of pico-USD ends at 9.2 million.
    """
    return join_parts(F.sum(micro_part(pico)), F.sum(rest_part(pico)))


def micro_part(pico: Column) -> Column:
    return F.call_function("div", pico, F.lit(1_000_000))


def rest_part(pico: Column) -> Column:
    return pico % F.lit(1_000_000)


def join_parts(micro: Column, rest: Column) -> Column:
    return F.coalesce(micro, F.lit(0)).cast("decimal(28,0)") * F.lit(1_000_000).cast(
        "decimal(7,0)"
    ) + F.coalesce(rest, F.lit(0)).cast("decimal(28,0)")


def usd_total(pico: Column) -> Column:
    """Sum of pico-USD as USD; 0.0 when there is nothing known to sum."""
    return usd(pico_total(pico))


def usd_decimal(pico: Column, scale: int) -> Column:
    """USD rounded half up to ``scale`` decimals, from exact pico-USD."""
    exact = pico.cast("decimal(24,0)") * F.lit("0.000000000001").cast("decimal(12,12)")
    return exact.cast(f"decimal(24,{scale})")
