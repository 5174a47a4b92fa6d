import random

import frames
import pytest
from pyspark.sql import functions as F

from spendlens.operators import pricing
from spendlens.schemas import PRICES


def usage(input, output, read=None, creation=None):
    return {
        "input_tokens": input,
        "output_tokens": output,
        "cache_read_input_tokens": read,
        "cache_creation_input_tokens": creation,
    }


CASES = [
    # model, usage, expected USD from the table rates
    ("gpt-4o-mini", usage(1_000_000, 0), 0.18),
    ("gpt-4o", usage(1_000_000, 0), 2.4),
    ("GPT-4o-2024-08-06", usage(1_000_000, 0), 2.4),
    ("deepseek-v4-pro", usage(120_000, 3_000, 70_000), 50_000e-6 * 0.31 + 70_000e-6 * 0.09 + 3e-3 * 1.2),
    ("claude-sonnet-4-5", usage(60_000, 30_000, 40_000, 7_000), 0.06 * 2.8 + 0.04 * 0.32 + 0.007 * 3.4 + 0.03 * 13.6),
    ("grok-4.3", usage(90_000, 2_000), 0.09 * 1.4 + 2e-3 * 2.9),
    ("grok-4.3", usage(310_000, 2_000), 0.31 * 2.6 + 2e-3 * 5.4),
    ("grok-4.3", usage(180_000, 0), 0.18 * 1.4),
    ("grok-4.3", usage(180_001, 0), 0.180001 * 2.6),
    # Context of additive accounting includes the cache.
    ("claude-sonnet-4-5", usage(130_000, 0, 40_000, 10_001), 0.13 * 5.2 + 0.04 * 0.55 + 0.010001 * 7.0),
    # Reads beyond the input leave nothing uncached.
    ("gpt-4o", usage(10, 0, 1_000_000), 1.1),
    ("mystery", usage(10, 10), None),
    ("gpt-4", usage(10, 10), None),
    (None, usage(10, 10), None),
    ("", usage(10, 10), None),
]


def test_prices(spark):
    calls = frames.calls(spark, [{"model": m} | u for m, u, _ in CASES])
    priced = pricing.price_calls(calls, frames.prices(spark))
    got = {r.id: r.usd for r in priced.select("id", pricing.usd(F.col("priced_pico")).alias("usd")).collect()}
    for i, (model, _, expected) in enumerate(CASES):
        if expected is None:
            assert got[str(i)] is None, model
        else:
            assert got[str(i)] == pytest.approx(expected, abs=1e-9), (model, i)


def test_cost_states(spark):
    calls = frames.calls(
        spark,
        [
            {"model": "gpt-x", "cost": 0.12} | usage(100, 50),
            {"model": "mystery"} | usage(100, 50),
            {"model": None} | usage(0, 0),
            {"model": "mystery"} | usage(None, None, 500),
            {"model": "gpt-4o"} | usage(None, None),
            {"model": "gpt-4o"} | usage(2**62, 1),
        ],
    )
    priced = pricing.with_cost_source(pricing.price_calls(calls, frames.prices(spark)))
    rows = {r.id: r for r in priced.collect()}
    assert [rows[str(i)].cost_pico for i in range(6)] == [120_000_000_000, None, 0, 0, 0, None]
    assert [rows[str(i)].cost_source for i in range(5)] == ["provider", None, None, None, "computed"]


def test_huge_counts_and_costs_leave_prices_unknown(spark):
    from spendlens.operators.stats import grouped_stats

    huge = {"model": "claude-sonnet-4-5"} | usage(9 * 10**18, 0, 9 * 10**18, 9 * 10**18)
    calls = frames.calls(spark, [huge, huge, {"model": "gpt-4o", "cost": 1e7}, {"model": "gpt-4o", "cost": 0.5}])
    got = {r.id: r.cost_pico for r in pricing.price_calls(calls, frames.prices(spark)).collect()}
    assert got == {"0": None, "1": None, "2": None, "3": 500_000_000_000}
    row = grouped_stats(calls, frames.prices(spark)).first()
    assert (row.calls, row.unpriced_calls, row.input_tokens, row.cost_usd) == (4, 3, None, 0.5)


def test_each_call_stays_one_row_whatever_the_tiers(spark):
    tier = lambda above, rate: (above, rate, rate, 0, 0)
    prices = spark.createDataFrame(
        [("m", 1, 1, 0, 0, True, [tier(None, 7), tier(10, 2), tier(10, 3), tier(5, 9)])] * 2
        + [("", 8, 8, 0, 0, True, None)],
        "model_key string, input_per_m int, output_per_m int, cache_read_per_m int, cache_creation_per_m int,"
        " cache_in_input boolean, tiers array<struct<above_input_tokens bigint, input_per_m int, output_per_m int,"
        " cache_read_per_m int, cache_creation_per_m int>>",
    )
    calls = frames.calls(spark, [{"model": "m-x", "input_tokens": n} for n in (1, 5, 6, 10, 11)])
    got = pricing.attach_rates(calls, prices).orderBy("id").collect()
    assert [r.input_units for r in got] == [1_000_000, 1_000_000, 9_000_000, 9_000_000, 3_000_000]


def brute_force(model, keys):
    hits = [k for k in keys if model.startswith(k)]
    return max(hits, key=len) if hits else None


@pytest.mark.parametrize("broadcast", [True, False])
def test_longest_prefix_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(pricing, "MOST_MODELS", 10)
    draw = random.Random(7)
    alphabet = "ab-é"
    keys = sorted({"".join(draw.choices(alphabet, k=draw.randint(1, 9))) for _ in range(300)})
    models = ["".join(draw.choices(alphabet, k=draw.randint(0, 12))) for _ in range(3000)] + keys
    prices = spark.createDataFrame(
        [(k, None, None, None, None, True, None) for k in keys], PRICES
    ).na.fill(0)
    calls = frames.calls(spark, [{"model": m, "input_tokens": 1} for m in models])
    got = pricing.attach_rates(calls, prices).select("id", "model_key").collect()
    assert len(got) == len(models)
    assert {r.id: r.model_key for r in got} == {
        str(i): brute_force(m, keys) for i, m in enumerate(models)
    }


def test_pricing_does_not_shuffle_the_calls(spark):
    calls = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "'gpt-4o-' || event_type AS model", "event_id AS input_tokens", "event_id AS output_tokens",
        "CAST(NULL AS BIGINT) AS cache_read_input_tokens",
        "CAST(NULL AS BIGINT) AS cache_creation_input_tokens", "value AS cost",
    )
    priced = pricing.price_calls(calls, pricing.rate_card(frames.prices(spark)))
    plan = priced._jdf.queryExecution().executedPlan().toString()
    facts, _, _ = plan.partition("BroadcastExchange")
    assert plan.count("BroadcastHashJoin") == 1 and "Exchange" not in facts.replace("BroadcastExchange", "")
    assert plan.count("FileScan parquet") == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_are_read_as_one_pruned_column(spark):
    calls = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("event_type", "model")
    plan = calls.select("model").distinct()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string>" in plan
    rates = pricing.model_rates(calls.select("model").distinct(), pricing.rate_card(frames.prices(spark)))
    assert rates.rows.num_rows == 0


def test_a_large_price_table_is_derived_once(spark, monkeypatch):
    monkeypatch.setattr(pricing, "MOST_MODELS", 5)
    seen = spark.sparkContext.accumulator(0)

    def counted(key):
        seen.add(1)
        return key

    rate = "CAST(1 AS DECIMAL(18,6))"
    prices = spark.range(40).select(
        F.udf(counted).asNondeterministic()(F.concat(F.lit("m-"), F.col("id"))).alias("model_key"),
        *[F.expr(rate).alias(c) for c in ("input_per_m", "output_per_m", "cache_read_per_m", "cache_creation_per_m")],
        F.lit(True).alias("cache_in_input"),
        F.expr("CAST(array() AS array<struct<above_input_tokens:bigint,input_per_m:decimal(18,6),output_per_m:decimal(18,6),"
               "cache_read_per_m:decimal(18,6),cache_creation_per_m:decimal(18,6)>>) AS tiers"),
    )
    calls = frames.calls(spark, [{"model": f"M-{i}x"} for i in range(40)])
    rated = pricing.attach_rates(calls, prices).select("model", "model_key").collect()
    assert {r.model: r.model_key for r in rated} == {f"M-{i}x": f"m-{i}" for i in range(40)}
    assert seen.value == 40
