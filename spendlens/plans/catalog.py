"""All registered queries, by key."""

from __future__ import annotations

from spendlens.plans import analytics, capture, stores  # noqa: F401  (they register queries)
from spendlens.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
