"""Small frames for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.plans import fixtures
from spendlens.schemas import CALLS, PRICES


def rows(spark: SparkSession, dicts: list[dict], schema: str) -> DataFrame:
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)


_DEFAULTS = {"ts": "2026-07-20 10:00:00", "provider": "openai", "latency_ms": 100, "stream": False}


def calls(spark: SparkSession, dicts: list[dict]) -> DataFrame:
    """Calls with defaults; ``ts`` is given as text in UTC."""
    full = [{"id": str(i)} | _DEFAULTS | d for i, d in enumerate(dicts)]
    types = {f.name: f.dataType.simpleString() for f in CALLS}
    text = ", ".join(f"{n} {'string' if n == 'ts' else t}" for n, t in types.items())
    return rows(spark, full, text).withColumn("ts", F.to_timestamp("ts"))


def no_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PRICES)


def prices(spark: SparkSession) -> DataFrame:
    return fixtures.prices(spark)
