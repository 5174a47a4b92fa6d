"""Queries over calls: bounds, pricing, statistics, budgets, listings and reviews."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import text
from spendlens.operators import budget, gaps, pricing, quality, review, sketches, stats, tail
from spendlens.plans import fixtures
from spendlens.plans.registry import query
from spendlens.schemas import PRICES
from spendlens.streaming.workdir import work_dir
from spendlens.timebounds import bound_literal, from_bound, is_bound, since, window_bound

NOW = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)
IN_DATA = datetime(2024, 1, 24, 20, 30, tzinfo=timezone.utc)
ZONE = "America/Los_Angeles"


@lru_cache(maxsize=4)
def card(spark: SparkSession) -> pricing.RateCard:
    """The sample rate card, laid out once per session."""
    return pricing.rate_card(fixtures.prices(spark))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price_calls(fixtures.calls(spark, sf_dir), card(spark))


# The SQL twin of pricing: every call with its rates, table price and cost in pico-USD.
PRICED_SQL = f"""
calls AS ({fixtures.CALLS_SQL}),
prices AS ({fixtures.PRICES_SQL}),
tiers AS ({fixtures.TIERS_SQL}),
matched AS (
  SELECT m.model, arg_max(p.model_key, length(p.model_key)) AS model_key
  FROM (SELECT DISTINCT model FROM calls) m
  JOIN prices p ON starts_with(lower(m.model), p.model_key) GROUP BY m.model),
counted AS (
  SELECT c.*, m.model_key, p.cache_in_input,
    p.input_per_m AS bi, p.output_per_m AS bo, p.cache_read_per_m AS br, p.cache_creation_per_m AS bc,
    CASE WHEN input_tokens > 0 THEN input_tokens ELSE 0 END AS i,
    CASE WHEN output_tokens > 0 THEN output_tokens ELSE 0 END AS o,
    CASE WHEN cache_read_input_tokens > 0 THEN cache_read_input_tokens ELSE 0 END AS r,
    CASE WHEN cache_creation_input_tokens > 0 THEN cache_creation_input_tokens ELSE 0 END AS w
  FROM calls c LEFT JOIN matched m ON m.model = c.model LEFT JOIN prices p ON p.model_key = m.model_key),
sized AS (
  SELECT *, CASE WHEN cache_in_input THEN i WHEN NOT cache_in_input THEN i + r + w END AS context_tokens,
    CASE WHEN cache_in_input THEN CASE WHEN i > r THEN i - r ELSE 0 END ELSE i END AS uncached
  FROM counted),
tiered AS (
  SELECT s.*,
    CAST(coalesce(t.input_per_m, bi) * 1000000 AS BIGINT) AS input_units,
    CAST(coalesce(t.output_per_m, bo) * 1000000 AS BIGINT) AS output_units,
    CAST(coalesce(t.cache_read_per_m, br) * 1000000 AS BIGINT) AS cache_read_units,
    CAST(coalesce(t.cache_creation_per_m, bc) * 1000000 AS BIGINT) AS cache_creation_units
  FROM sized s LEFT JOIN tiers t ON t.model_key = s.model_key
    AND t.above_input_tokens = (SELECT max(above_input_tokens) FROM tiers u
      WHERE u.model_key = s.model_key AND u.above_input_tokens < s.context_tokens)),
costed AS (
  SELECT *, uncached * input_units + r * cache_read_units + w * cache_creation_units
    + o * output_units AS priced_pico,
    CAST(floor(cost * 1000000000000e0 + 0.5e0) AS BIGINT) AS stored_pico
  FROM tiered),
priced AS (
  SELECT *, coalesce(stored_pico, priced_pico, CASE WHEN i = 0 AND o = 0 THEN 0 END) AS cost_pico
  FROM costed)
"""


def with_priced(select: str, more: str = "") -> str:
    return f"WITH {PRICED_SQL}{', ' + more if more else ''} {select}"


def usd_sql(total: str) -> str:
    return f"CAST({total} AS DOUBLE) / 1000000000000e0"


def utc(bound: datetime) -> str:
    return f"TIMESTAMP '{bound.astimezone(timezone.utc).replace(tzinfo=None)}'"


# --- time bounds -----------------------------------------------------------------------------


def _by_provider(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider").agg(F.count("*").alias("calls"), F.min("ts").alias("first_ts"))


def _by_provider_sql(bound: datetime) -> str:
    return f"""WITH calls AS ({fixtures.CALLS_SQL})
        SELECT provider, count(*) AS calls, min(ts) AS first_ts
        FROM calls WHERE ts >= {utc(bound)} GROUP BY provider"""


def _since_query(spec: str, now: datetime, tz: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _by_provider(since(fixtures.calls(spark, sf_dir), spec, now, tz))

    return run


def at_utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


for _key, _spec, _now, _tz, _bound in [
    ("t1_since_instant", "2024-01-20T06:00:00Z", NOW, "UTC", at_utc(2024, 1, 20, 6)),
    ("t2_since_days", "7d", NOW, ZONE, at_utc(2024, 1, 24, 12)),
    ("t2_since_hours", "100h", NOW, ZONE, at_utc(2024, 1, 27, 8)),
    ("t2_since_minutes", "4500m", NOW, ZONE, at_utc(2024, 1, 28, 9)),
    ("t3_since_today", "Today", IN_DATA, ZONE, at_utc(2024, 1, 24, 8)),
    ("t4_since_offset", "2024-01-18T10:00:00+08:00", NOW, "UTC", at_utc(2024, 1, 18, 2)),
    ("t5_since_date", "2024-01-15", NOW, ZONE, at_utc(2024, 1, 15)),
    ("t5_since_month", "2024-01", NOW, ZONE, at_utc(2024, 1, 1)),
]:
    query(_key, _by_provider_sql(_bound))(_since_query(_spec, _now, _tz))


# Each customer as a time bound: relative ones, dates, instants, and texts that are none.
_SPEC_SQL = """CASE c_custkey % 8 WHEN 0 THEN CAST(c_custkey AS VARCHAR) || 'd'
    WHEN 1 THEN CAST(c_custkey AS VARCHAR) || 'w' WHEN 2 THEN 'yesterday'
    WHEN 3 THEN '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')
    WHEN 4 THEN '2024-01-05T10:00:00' WHEN 5 THEN '2024-01-05T10:00:00Z'
    WHEN 6 THEN '-' || CAST(c_custkey AS VARCHAR) || 'h' ELSE CAST(c_custkey AS VARCHAR) || 'm' END"""


@query(
    "t6_accepted_bounds",
    f"""SELECT c_custkey, {_SPEC_SQL} AS spec, c_custkey % 8 IN (0, 3, 5, 7) AS accepted FROM customer""",
)
def accepted_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fixtures.table(spark, sf_dir, "customer")
    spec = F.expr(_SPEC_SQL.replace("VARCHAR", "STRING")).alias("spec")
    return customers.select("c_custkey", spec).withColumn("accepted", is_bound(F.col("spec")))


@query(
    "t7_calendar_windows",
    f"""WITH calls AS ({fixtures.CALLS_SQL}),
    bounds AS (SELECT 'day' AS period, {utc(at_utc(2024, 1, 24, 8))} AS bound
      UNION ALL SELECT 'week', {utc(at_utc(2024, 1, 22, 8))}
      UNION ALL SELECT 'month', {utc(at_utc(2024, 1, 1, 8))})
    SELECT period, count(*) AS calls, min(ts) AS first_ts
    FROM bounds JOIN calls ON ts >= bound GROUP BY period""",
)
def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = fixtures.calls(spark, sf_dir).select("ts")
    bounds = {p: window_bound(p, IN_DATA, ZONE) for p in ("day", "week", "month")}
    recent = from_bound(calls, min(bounds.values()))
    starts = {p: bound_literal(b, calls.schema["ts"].dataType) for p, b in bounds.items()}
    counts = recent.agg(
        *[F.count_if(F.col("ts") >= s).alias(f"{p}_calls") for p, s in starts.items()],
        *[F.min(F.when(F.col("ts") >= s, F.col("ts"))).alias(f"{p}_first") for p, s in starts.items()],
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("period"),
                        F.col(f"{p}_calls").alias("calls"),
                        F.col(f"{p}_first").alias("first_ts"),
                    )
                    for p in bounds
                ]
            )
        )
    )


# --- pricing ---------------------------------------------------------------------------------


@query(
    "p1_rate_lookup",
    with_priced("SELECT model, model_key, count(*) AS calls FROM priced GROUP BY ALL"),
)
def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pricing.attach_rates(fixtures.calls(spark, sf_dir), card(spark))
    return rated.groupBy("model", "model_key").agg(F.count("*").alias("calls"))


@query(
    "p1_rate_lookup_by_part_type",
    """WITH keys AS (SELECT DISTINCT lower(left(p_type, n)) AS model_key
        FROM part, (VALUES (2), (4), (7), (10), (14)) AS lengths(n))
    SELECT p_partkey, max_by(model_key, length(model_key)) AS model_key,
      CAST(max(length(model_key)) AS BIGINT) * 1000000 AS input_units
    FROM part LEFT JOIN keys ON starts_with(lower(p_type), model_key) GROUP BY p_partkey""",
)
def rate_lookup_by_part_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested keys of several lengths, some shorter than a bucket name."""
    parts = fixtures.table(spark, sf_dir, "part")
    keys = (
        parts.selectExpr("explode(array(2, 4, 7, 10, 14)) AS n", "p_type")
        .selectExpr("lower(left(p_type, n)) AS model_key")
        .distinct()
        .selectExpr(
            "model_key",
            "CAST(length(model_key) AS DECIMAL(18,6)) AS input_per_m",
            "CAST(0 AS DECIMAL(18,6)) AS output_per_m",
            "CAST(0 AS DECIMAL(18,6)) AS cache_read_per_m",
            "CAST(0 AS DECIMAL(18,6)) AS cache_creation_per_m",
            "true AS cache_in_input",
            f"CAST(NULL AS {PRICES['tiers'].dataType.simpleString()}) AS tiers",
        )
    )
    calls = parts.selectExpr(
        "p_partkey", "p_type AS model", "CAST(1 AS BIGINT) AS input_tokens",
        "CAST(0 AS BIGINT) AS cache_read_input_tokens",
        "CAST(0 AS BIGINT) AS cache_creation_input_tokens",
    )
    return pricing.attach_rates(calls, keys).select("p_partkey", "model_key", "input_units")


@query(
    "p2_cache_accounting",
    with_priced(
        """SELECT provider, cache_in_input, coalesce(cache_in_input, true) AS assumed,
        count(*) AS calls FROM priced GROUP BY ALL"""
    ),
)
def cache_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pricing.attach_rates(fixtures.calls(spark, sf_dir), card(spark))
    return rated.groupBy(
        "provider", "cache_in_input", F.expr("coalesce(cache_in_input, true) AS assumed")
    ).agg(F.count("*").alias("calls"))


@query("p3_context_tokens", with_priced("SELECT id, context_tokens FROM priced"))
def context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pricing.attach_rates(fixtures.calls(spark, sf_dir), card(spark))
    context = f"CASE WHEN model_key IS NOT NULL THEN {pricing.CONTEXT_TOKENS} END AS context_tokens"
    return rated.selectExpr("id", context)


@query(
    "p4_effective_rates",
    with_priced(
        """SELECT id, model_key, input_units, output_units, cache_read_units,
        cache_creation_units FROM priced"""
    ),
)
def effective_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pricing.attach_rates(fixtures.calls(spark, sf_dir), card(spark))
    return rated.select("id", "model_key", *pricing.UNIT_COLUMNS)


@query(
    "p5_computed_price",
    with_priced(f"SELECT id, model, {usd_sql('priced_pico')} AS priced_usd FROM priced"),
)
def computed_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select(
        "id", "model", pricing.usd(F.col("priced_pico")).alias("priced_usd")
    )


_COUNTS = {
    "input_tokens": "i",
    "output_tokens": "o",
    "cache_read_input_tokens": "r",
    "cache_creation_input_tokens": "w",
}


@query(
    "p6_zero_as_absent",
    with_priced(
        "SELECT id, " + ", ".join(f"nullif({v}, 0) AS {c}" for c, v in _COUNTS.items())
        + " FROM priced"
    ),
)
def zero_as_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.calls(spark, sf_dir).selectExpr(
        "id", *[f"nullif({pricing.counted(c)}, 0) AS {c}" for c in _COUNTS]
    )


@query(
    "p7_call_cost",
    with_priced(f"SELECT id, {usd_sql('cost_pico')} AS cost_usd FROM priced"),
)
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("id", pricing.usd(F.col("cost_pico")).alias("cost_usd"))


SOURCED_SQL = f"""sourced AS (SELECT *,
    CASE WHEN cost IS NOT NULL THEN cost ELSE {usd_sql('priced_pico')} END AS cost_usd,
    CASE WHEN cost IS NOT NULL THEN 'provider' WHEN priced_pico IS NOT NULL THEN 'computed' END
      AS cost_source FROM priced)"""


@query(
    "p8_cost_with_source",
    with_priced("SELECT id, cost_usd, cost_source FROM sourced", SOURCED_SQL),
)
def cost_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.with_cost_source(priced(spark, sf_dir)).select("id", "cost_usd", "cost_source")


# --- statistics ------------------------------------------------------------------------------

_GROUP_KEYS_SQL = {
    "provider": "provider",
    "model": "coalesce(model, 'unknown')",
    "client": "coalesce(client, 'unknown')",
    "day": "strftime(ts, '%Y-%m-%d')",
    "exe": "coalesce(peer_exe, 'unknown')",
}


def stats_sql(by: str) -> str:
    return with_priced(
        f"""SELECT {by}, calls, input_tokens, output_tokens, cache_read_tokens,
          cache_creation_tokens,
          CASE WHEN denom > 0 AND cache_read_tokens > 0
            THEN cache_read_tokens * 100.0e0 / denom END AS cache_hit_pct,
          errors, p50_ms, p95_ms, {usd_sql('total')} AS cost_usd, unpriced_calls
        FROM (SELECT {_GROUP_KEYS_SQL[by]} AS {by}, count(*) AS calls,
          CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
          CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
          CAST(sum(coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS cache_read_tokens,
          CAST(sum(coalesce(cache_creation_input_tokens, 0)) AS BIGINT) AS cache_creation_tokens,
          CAST(sum(CASE WHEN coalesce(cache_in_input, TRUE) THEN coalesce(input_tokens, 0)
            ELSE coalesce(input_tokens, 0) + coalesce(cache_read_input_tokens, 0)
              + coalesce(cache_creation_input_tokens, 0) END) AS BIGINT) AS denom,
          count(*) FILTER (error_kind IS NOT NULL OR coalesce(status, 0) >= 400) AS errors,
          CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT) AS p50_ms,
          CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS BIGINT) AS p95_ms,
          coalesce(sum(cost_pico), 0) AS total,
          count(*) - count(cost_pico) AS unpriced_calls
        FROM priced GROUP BY 1)"""
    )


def _stats_query(by: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.grouped_stats(fixtures.calls(spark, sf_dir), card(spark), by)

    return run


for _key, _by in [
    ("a1_stats_by_provider", "provider"),
    ("a2_stats_by_model", "model"),
    ("a3_stats_by_client", "client"),
    ("a4_stats_by_day", "day"),
    ("a5_stats_by_exe", "exe"),
]:
    query(_key, stats_sql(_by))(_stats_query(_by))


@query(
    "a6_measures",
    f"""SELECT calls, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens,
    cost_usd, day FROM ({stats_sql('day')})""",
)
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stats.grouped_stats(fixtures.calls(spark, sf_dir), card(spark), "day")
    return report.drop("cache_hit_pct", "errors", "p50_ms", "p95_ms", "unpriced_calls")


@query(
    "a7_error_counts",
    f"""WITH calls AS ({fixtures.CALLS_SQL}) SELECT provider, error_kind, status,
    count(*) AS calls,
    count(*) FILTER (error_kind IS NOT NULL OR coalesce(status, 0) >= 400) AS errors
    FROM calls GROUP BY ALL""",
)
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fixtures.calls(spark, sf_dir)
        .groupBy("provider", "error_kind", "status")
        .agg(F.count("*").alias("calls"), F.expr(f"count_if({stats.IS_ERROR}) AS errors"))
    )


@query(
    "a8_cache_denominator",
    with_priced(
        """SELECT provider, CAST(sum(CASE WHEN coalesce(cache_in_input, TRUE)
          THEN coalesce(input_tokens, 0) ELSE coalesce(input_tokens, 0)
          + coalesce(cache_read_input_tokens, 0) + coalesce(cache_creation_input_tokens, 0) END)
          AS BIGINT) AS cache_denom FROM priced GROUP BY provider"""
    ),
)
def cache_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = pricing.attach_rates(fixtures.calls(spark, sf_dir), card(spark))
    return rated.groupBy("provider").agg(
        F.expr(f"sum({stats.CACHE_DENOMINATOR}) AS cache_denom")
    )


@query("a9_cache_hit_pct", f"SELECT client, cache_hit_pct FROM ({stats_sql('client')})")
def cache_hit_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stats.grouped_stats(fixtures.calls(spark, sf_dir), card(spark), "client")
    return report.select("client", "cache_hit_pct")


@query("a10_latency_percentiles", f"SELECT provider, p50_ms, p95_ms FROM ({stats_sql('provider')})")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stats.grouped_stats(fixtures.calls(spark, sf_dir), card(spark), "provider")
    return report.select("provider", "p50_ms", "p95_ms")


@query(
    "a10_latency_percentiles_approximate",
    f"""WITH calls AS ({fixtures.CALLS_SQL}) SELECT provider, count(latency_ms) AS timed, TRUE AS p50_ms_ok,
      TRUE AS p95_ms_ok FROM calls GROUP BY provider""",
)
def latency_percentiles_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles off sketches stored by day and merged, held against the true ranks of their values."""
    calls = fixtures.calls(spark, sf_dir)
    folder = work_dir(spark, "sketches")
    sketches.latency_sketches(calls).write.partitionBy("day").parquet(folder)
    read = sketches.percentiles(spark.read.parquet(folder))
    return sketches.within_error(read, calls).select("provider", "timed", "p50_ms_ok", "p95_ms_ok")


_UNPRICED_SQL = """SELECT coalesce(model, 'unknown') AS model, count(*) AS calls
    FROM priced WHERE cost_pico IS NULL GROUP BY 1"""


@query("a11_unpriced_models", with_priced(_UNPRICED_SQL))
def unpriced_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unpriced_models(fixtures.calls(spark, sf_dir), card(spark))


@query(
    "a11_unpriced_summary",
    with_priced(
        """SELECT CAST(sum(calls) AS BIGINT) AS unpriced_calls,
          string_agg(model || ' (' || calls || ')', ', ' ORDER BY calls DESC, model) FILTER (nth <= 3) AS top,
          'price table is 3 days old' AS age
        FROM (SELECT *, row_number() OVER (ORDER BY calls DESC, model) AS nth FROM unpriced)""",
        f"unpriced AS ({_UNPRICED_SQL})",
    ),
)
def unpriced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unpriced_summary(fixtures.calls(spark, sf_dir), card(spark), age_days=3)


@query("k2_top_unpriced_models", with_priced(_UNPRICED_SQL + " ORDER BY calls DESC, model LIMIT 3"))
def top_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_unpriced_models(fixtures.calls(spark, sf_dir), card(spark))


@query("k3_group_order", f"SELECT model, calls FROM ({stats_sql('model')}) ORDER BY model")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stats.grouped_stats(fixtures.calls(spark, sf_dir), card(spark), "model")
    return report.select("model", "calls")


# --- budget ----------------------------------------------------------------------------------


def _spend_sql(bound: datetime) -> str:
    return f"""SELECT {usd_sql('coalesce(sum(cost_pico), 0)')} AS spent,
        count(*) - count(cost_pico) AS unpriced_calls FROM priced WHERE ts >= {utc(bound)}"""


@query("a12_budget_spend", with_priced(_spend_sql(at_utc(2024, 1, 22, 8))))
def budget_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = window_bound("week", IN_DATA, ZONE)
    return budget.spend(from_bound(fixtures.calls(spark, sf_dir), bound), card(spark))


def verdict_sql(bound: datetime, window: str, amount: str) -> str:
    return f"""SELECT '{window}' AS "window",
        strftime({utc(bound)}, '%Y-%m-%dT%H:%M:%SZ') AS since, spent,
        {amount}e0 AS budget, spent / {amount}e0 * 100.0e0 AS pct, spent >= {amount}e0 AS over,
        {amount}e0 - spent AS remaining, unpriced_calls,
        CASE WHEN spent >= {amount}e0 THEN 'over' WHEN unpriced_calls > 0 THEN 'unknown'
          ELSE 'ok' END AS status
        FROM ({_spend_sql(bound)})"""


def _check_query(spec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return budget.budget_check(
            fixtures.calls(spark, sf_dir), card(spark), spec, IN_DATA, ZONE
        )

    return run


for _key, _spec, _bound, _window, _amount in [
    ("a13_verdict_over", "50/month", at_utc(2024, 1, 1, 8), "month", "50.0"),
    ("a13_verdict_unknown", "900000000/week", at_utc(2024, 1, 22, 8), "week", "900000000.0"),
    ("a14_budget_spec", " 12.50 / 36h ", at_utc(2024, 1, 23, 8, 30), "36h", "12.5"),
]:
    query(_key, with_priced(verdict_sql(_bound, _window, _amount)))(_check_query(_spec))


_LINE_SQL = """SELECT "window" || ': $' || CAST(CAST(spent AS DECIMAL(24,2)) AS VARCHAR)
    || ' / $' || CAST(CAST(budget AS DECIMAL(24,2)) AS VARCHAR)
    || ' (' || CAST(CAST(pct AS DECIMAL(24,0)) AS VARCHAR) || '%) — ' || CASE WHEN over
    THEN 'OVER by $' || CAST(CAST(-remaining AS DECIMAL(24,2)) AS VARCHAR)
    WHEN unpriced_calls > 0 THEN 'unknown (' || unpriced_calls || ' unpriced)' ELSE 'ok' END AS line"""


@query(
    "d5_budget_line",
    with_priced(
        f"""{_LINE_SQL} FROM ({verdict_sql(at_utc(2024, 1, 1, 8), 'month', '50.0')})
        UNION ALL {_LINE_SQL} FROM ({verdict_sql(at_utc(2024, 1, 22, 8), 'week', '900000000.0')})"""
    ),
)
def budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = fixtures.calls(spark, sf_dir)
    over, under = (
        budget.budget_check(calls, card(spark), spec, IN_DATA, ZONE)
        for spec in ("50/month", "900000000/week")
    )
    return budget.budget_line(over.unionByName(under))


# --- listing ---------------------------------------------------------------------------------

LISTED_SQL = ", ".join(f"{c} AS {name}" for c, name in tail.LISTED.items())


@query(
    "k1_tail",
    with_priced(
        f"SELECT ingest_seq, {LISTED_SQL} FROM sourced ORDER BY ingest_seq DESC LIMIT 20",
        SOURCED_SQL,
    ),
)
def tail_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.tail(fixtures.calls(spark, sf_dir), card(spark))


@query(
    "k1_tail_since",
    with_priced(
        f"""SELECT ingest_seq, {LISTED_SQL} FROM sourced WHERE ts >= {utc(at_utc(2024, 1, 29))}
        ORDER BY ingest_seq DESC LIMIT 7""",
        SOURCED_SQL,
    ),
)
def tail_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = since(fixtures.calls(spark, sf_dir), "2024-01-29", NOW)
    return tail.tail(calls, card(spark), n=7)


_LABELS_SQL = """labelled AS (SELECT ingest_seq, ts, provider, model, status, latency_ms, anomaly,
    coalesce(CAST(status AS VARCHAR), 'err') AS status_label,
    CASE WHEN input_tokens IS NULL THEN '?' ELSE CAST(input_tokens AS VARCHAR) || '→'
      || coalesce(CAST(output_tokens AS VARCHAR), '?') END AS tokens_label,
    CASE WHEN cache_read_input_tokens > 0
      THEN 'cache_read=' || CAST(cache_read_input_tokens AS VARCHAR) END AS cache_label,
    '$' || CAST(CAST(CAST(floor(cost_usd * 1000000000000e0 + 0.5e0) AS DECIMAL(24,0))
      * CAST(0.000000000001 AS DECIMAL(12,12)) AS DECIMAL(24,4)) AS VARCHAR) AS cost_label,
    CASE WHEN error_kind IS NOT NULL THEN error_kind WHEN status = 429 THEN 'rate_limit'
      WHEN status >= 400 THEN 'http_' || CAST(status AS VARCHAR) END AS error_label,
    left(regexp_extract(client, '(\\S+)', 1), 40) AS client_label
    FROM sourced)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.priced_listing(fixtures.calls(spark, sf_dir), card(spark))


@query(
    "d3_error_label",
    with_priced("SELECT ingest_seq, error_label FROM labelled", f"{SOURCED_SQL}, {_LABELS_SQL}"),
)
def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.with_labels(_listing(spark, sf_dir)).select("ingest_seq", "error_label")


@query(
    "d4_listing_labels",
    with_priced(
        """SELECT ingest_seq, status_label, tokens_label, cache_label, cost_label, client_label
        FROM labelled""",
        f"{SOURCED_SQL}, {_LABELS_SQL}",
    ),
)
def listing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.with_labels(_listing(spark, sf_dir)).select(
        "ingest_seq", "status_label", "tokens_label", "cache_label", "cost_label", "client_label"
    )


@query(
    "d4_listing_lines",
    with_priced(
        """SELECT ingest_seq, '[' || replace(CAST(ts AS VARCHAR), ' ', 'T') || 'Z] ' || provider || ' '
        || coalesce(model, '?') || ' ' || status_label || ' ' || CAST(latency_ms AS VARCHAR)
        || 'ms tokens=' || tokens_label || coalesce(' ' || cache_label, '')
        || coalesce(' ' || cost_label, '') || coalesce(' ERROR=' || error_label, '')
        || coalesce(' ANOMALY=' || anomaly, '')
        || coalesce(' client=' || client_label, '') AS line FROM labelled""",
        f"{SOURCED_SQL}, {_LABELS_SQL}",
    ),
)
def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tail.lines(_listing(spark, sf_dir))


@query(
    "d1_display_key",
    """SELECT conv_id, turn, CASE WHEN length(text) > 48 THEN left(text, 48) || '…' ELSE text END
    AS shown FROM conversations""",
)
def display_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fixtures.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text.display_key(F.col("text")).alias("shown"))


@query(
    "d2_short_client",
    """SELECT conv_id, turn, left(CASE WHEN regexp_extract(text, '(\\S+)', 1) = '' THEN text
    ELSE regexp_extract(text, '(\\S+)', 1) END, 40) AS shown FROM conversations""",
)
def short_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fixtures.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text.short_client(F.col("text")).alias("shown"))


@query(
    "d6_stats_formats",
    f"""SELECT client, coalesce(CAST(CAST(cache_hit_pct AS DECIMAL(24,0)) AS VARCHAR) || '%', '-')
      AS cache_pct, CAST(CAST(cost_usd AS DECIMAL(24,4)) AS VARCHAR) AS cost
    FROM ({stats_sql('client')})""",
)
def stats_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stats.grouped_stats(fixtures.calls(spark, sf_dir), card(spark), "client")
    return stats.with_formats(report).select("client", "cache_pct", "cost")


# --- spend review ----------------------------------------------------------------------------


@query(
    "a15_spend_by_source_and_model",
    f"""WITH calls AS ({fixtures.CALLS_SQL})
    SELECT coalesce(client, peer_exe, 'unknown') AS src, model, count(*) AS n,
      {usd_sql("sum(CAST(floor(cost * 1000000000000e0 + 0.5e0) AS BIGINT))")} AS spent,
      CAST(sum(input_tokens) AS BIGINT) AS inp, CAST(sum(cache_read_input_tokens) AS BIGINT) AS hit,
      CAST(sum(output_tokens) AS BIGINT) AS out,
      CAST(sum(reasoning_output_tokens) AS BIGINT) AS think
    FROM calls GROUP BY 1, 2""",
)
def spend_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.spend_by_source_and_model(fixtures.calls(spark, sf_dir))


_GAPS_SQL = """lagged AS (SELECT *, lag(ts) OVER (PARTITION BY provider ORDER BY ts, id) AS previous_ts
      FROM priced WHERE input_tokens > 0),
    gapped AS (SELECT *, date_diff('microsecond', previous_ts, ts) / 1000000e0 AS gap_s
      FROM lagged WHERE previous_ts IS NOT NULL),
    bucketed AS (SELECT *, CASE WHEN gap_s < 30 THEN '<30s' WHEN gap_s < 300 THEN '30s-5m'
      WHEN gap_s < 900 THEN '5-15m' WHEN gap_s < 3600 THEN '15-60m' ELSE '>1h' END AS gap_bucket
      FROM gapped)"""


@query("w1_idle_gaps", with_priced("SELECT id, provider, previous_ts, gap_s FROM gapped", _GAPS_SQL))
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = gaps.idle_gaps(fixtures.calls(spark, sf_dir))
    return active.select("id", "provider", "previous_ts", "gap_s")


@query(
    "a16_cache_decay",
    with_priced(
        """SELECT gap_bucket AS bucket, count(*) AS n,
          round(100.0e0 * sum(cache_read_input_tokens) / sum(input_tokens), 1) AS hit_pct,
          round(100.0e0 * sum(cache_read_input_tokens)
            / sum(CASE WHEN NOT cache_in_input THEN i + r + w ELSE i END), 1) AS prompt_hit_pct,
          min(gap_s) AS min_gap_s
        FROM bucketed GROUP BY 1""",
        _GAPS_SQL,
    ),
)
def cache_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.cache_decay(fixtures.calls(spark, sf_dir), card(spark))


@query(
    "v1_uncached_by_accounting",
    with_priced(
        """SELECT provider, CASE WHEN cache_in_input THEN 'subset' WHEN NOT cache_in_input
            THEN 'additive' ELSE 'unknown' END AS accounting, count(*) AS calls,
          CAST(sum(CASE WHEN NOT cache_in_input THEN i WHEN i > r THEN i - r ELSE 0 END) AS BIGINT)
            AS uncached_tokens,
          CAST(sum(r) AS BIGINT) AS cache_read_tokens,
          CAST(sum(CASE WHEN NOT cache_in_input THEN i + r + w ELSE i END) AS BIGINT)
            AS prompt_tokens FROM priced GROUP BY 1, 2"""
    ),
)
def uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.uncached_by_accounting(fixtures.calls(spark, sf_dir), card(spark))


@query(
    "v2_repriced",
    with_priced(
        f"""SELECT coalesce(model, 'unknown') AS model, count(*) AS calls,
          count(cost) AS reported_calls, {usd_sql('sum(stored_pico)')} AS paid_usd,
          count(priced_pico) AS repriced_calls,
          {usd_sql('sum(priced_pico)')} AS at_current_rates_usd FROM priced GROUP BY 1"""
    ),
)
def repriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.repriced(fixtures.calls(spark, sf_dir), card(spark))


@query(
    "v3_avoidable_misses",
    with_priced(
        f"""SELECT gap_bucket, count(*) AS calls, count(*) - count(model_key) AS unpriced_calls,
          CAST(coalesce(sum(CASE WHEN model_key IS NOT NULL THEN uncached END), 0) AS BIGINT)
            AS uncached_tokens,
          {usd_sql('coalesce(sum(uncached * (input_units - cache_read_units)), 0)')}
            AS avoidable_usd,
          min(gap_s) AS min_gap_s FROM bucketed GROUP BY 1""",
        _GAPS_SQL,
    ),
)
def avoidable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.avoidable_misses(fixtures.calls(spark, sf_dir), card(spark))


# Sample candidates (price key, candidate model, class of work).
CANDIDATES = [
    ("claude-sonnet-4", "claude-haiku-4", "coding"),
    ("claude-sonnet-4", "deepseek-v4-pro", "coding"),
    ("gpt-4o", "gpt-4o-mini", "chat"),
    ("gpt-4o", "grok-4.3", "chat"),
    ("grok-4.3", "claude-sonnet-4-5", "chat"),
    ("gemini-2.0-flash", "unlisted-model", "extraction"),
]


@query(
    "v5_substitutions",
    with_priced(
        f"""SELECT src, model_key, candidate, task_class, count(*) AS calls,
          count(*) - count(both_ok) AS unpriced_calls,
          {usd_sql('coalesce(sum(CASE WHEN both_ok THEN priced_pico END), 0)')} AS current_usd,
          {usd_sql('coalesce(sum(CASE WHEN both_ok THEN to_pico END), 0)')} AS candidate_usd,
          {usd_sql('coalesce(sum(CASE WHEN both_ok THEN priced_pico - to_pico END), 0)')} * 30.0e0
            / 30.0e0 AS saving_30d_usd
        FROM (SELECT *, CASE WHEN to_pico IS NOT NULL THEN TRUE END AS both_ok FROM (
          SELECT z.*, (CASE WHEN to_subset THEN CASE WHEN ci > r THEN ci - r ELSE 0 END ELSE ci END)
              * CAST(coalesce(t.input_per_m, pi) * 1000000 AS BIGINT)
            + r * CAST(coalesce(t.cache_read_per_m, pr) * 1000000 AS BIGINT)
            + cw * CAST(coalesce(t.cache_creation_per_m, pc) * 1000000 AS BIGINT)
            + o * CAST(coalesce(t.output_per_m, po) * 1000000 AS BIGINT) AS to_pico
          FROM restated z LEFT JOIN tiers t ON t.model_key = z.to_key
            AND CASE WHEN to_subset THEN ci ELSE ci + r + cw END > t.above_input_tokens))
        GROUP BY 1, 2, 3, 4""",
        f"""candidates AS (SELECT * FROM (VALUES {fixtures.values_sql(CANDIDATES)})
          AS t(from_key, candidate, task_class)),
        target AS (SELECT candidate, arg_max(model_key, length(model_key)) AS to_key
          FROM (SELECT DISTINCT candidate FROM candidates)
          JOIN prices ON starts_with(candidate, model_key) GROUP BY 1),
        restated AS (SELECT coalesce(client, peer_exe, 'unknown') AS src, p.model_key, c.candidate,
            c.task_class, p.priced_pico, g.to_key, q.cache_in_input AS to_subset, p.r, p.o,
            q.input_per_m AS pi, q.output_per_m AS po, q.cache_read_per_m AS pr,
            q.cache_creation_per_m AS pc,
            CASE WHEN q.cache_in_input AND NOT p.cache_in_input THEN p.i + p.r + p.w
              WHEN NOT q.cache_in_input AND p.cache_in_input
                THEN CASE WHEN p.i > p.r THEN p.i - p.r ELSE 0 END ELSE p.i END AS ci,
            CASE WHEN q.cache_in_input AND NOT p.cache_in_input THEN 0 ELSE p.w END AS cw
          FROM priced p JOIN candidates c ON c.from_key = p.model_key
          LEFT JOIN target g ON g.candidate = c.candidate
          LEFT JOIN prices q ON q.model_key = g.to_key)""",
    ),
)
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("model_key"),
                        F.lit(c).alias("candidate"),
                        F.lit(t).alias("task_class"),
                    )
                    for m, c, t in CANDIDATES
                ]
            )
        )
    )
    return review.substitutions(fixtures.calls(spark, sf_dir), card(spark), candidates, days=30)


@query(
    "v6_evaluation_bursts",
    f"""WITH calls AS ({fixtures.CALLS_SQL}),
    ordered AS (SELECT coalesce(client, peer_exe, 'unknown') AS src,
      coalesce(model, 'unknown') AS model, ts, id FROM calls),
    flagged AS (SELECT *, CASE WHEN date_diff('microsecond',
        lag(ts) OVER (PARTITION BY src ORDER BY ts, id), ts) <= 900000000 THEN 0 ELSE 1 END AS starts
      FROM ordered),
    sessions AS (SELECT *, sum(starts) OVER (PARTITION BY src ORDER BY ts, id) AS session
      FROM flagged),
    counted AS (SELECT src, session, model, count(*) AS n, min(ts) AS a, max(ts) AS b
      FROM sessions GROUP BY ALL)
    SELECT src, min(a) AS started, max(b) AS ended, count(*) AS models, min(n) AS calls_per_model
    FROM counted GROUP BY src, session HAVING min(n) = max(n) AND count(*) >= 3""",
)
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.evaluation_bursts(fixtures.calls(spark, sf_dir), idle_seconds=900)


@query(
    "v7_coverage",
    f"""WITH calls AS ({fixtures.CALLS_SQL})
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls,
      count(*) - count(cost) AS no_cost, count(*) - count(client) AS no_client,
      count(*) - count(peer_exe) AS no_peer_exe, count(*) - count(raw_usage) AS no_raw_usage
    FROM calls GROUP BY 1""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage(fixtures.calls(spark, sf_dir))


@query(
    "v8_union_hosts",
    f"""WITH calls AS ({fixtures.CALLS_SQL}), hosts AS (
      SELECT CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'alpha' ELSE 'beta' END AS host, * FROM calls)
    SELECT host, provider, count(*) AS calls,
      CASE WHEN host = 'alpha' THEN 0 ELSE count(client) END AS with_client,
      CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM hosts GROUP BY host, provider""",
)
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host with an old table that lacks the later columns, one with a current table."""
    calls = fixtures.calls(spark, sf_dir)
    old = calls.where("ts < TIMESTAMP_NTZ '2024-01-12'").drop("client", "raw_usage", "peer_exe")
    new = calls.where("ts >= TIMESTAMP_NTZ '2024-01-12'")
    return (
        review.union_hosts({"alpha": old, "beta": new})
        .groupBy("host", "provider")
        .agg(
            F.count("*").alias("calls"),
            F.count("client").alias("with_client"),
            F.sum("input_tokens").alias("input_tokens"),
        )
    )


# --- row quality -----------------------------------------------------------------------------


@query(
    "r1_null_is_not_zero",
    f"""WITH calls AS ({fixtures.CALLS_SQL}) SELECT provider, count(*) AS calls,
      count(input_tokens) AS reported, count(*) FILTER (input_tokens = 0) AS reported_zero,
      CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens FROM calls GROUP BY 1""",
)
def null_is_not_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fixtures.calls(spark, sf_dir)
        .groupBy("provider")
        .agg(
            F.count("*").alias("calls"),
            F.count("input_tokens").alias("reported"),
            F.expr("count_if(input_tokens = 0) AS reported_zero"),
            F.expr("sum(coalesce(input_tokens, 0)) AS input_tokens"),
        )
    )


_RAW_CELLS = {
    "id": "CAST(event_id AS STRING)",
    "provider": fixtures.CALLS["provider"],
    "latency_ms": "CAST(event_id AS STRING)",
    "input_tokens": """CASE WHEN event_type = 'error' THEN NULL
        WHEN event_type = 'signup' THEN 'not-an-integer' ELSE CAST(user_id AS STRING) END""",
}


@query(
    "r2_lenient_decode",
    f"""WITH raw AS ({fixtures.columns_sql(_RAW_CELLS, 'events')})
    SELECT provider, count(*) AS calls,
      CAST(sum(CAST(input_tokens AS BIGINT)) AS BIGINT) AS input_tokens
    FROM raw WHERE input_tokens IS NULL OR TRY_CAST(input_tokens AS BIGINT) IS NOT NULL GROUP BY 1""",
)
def lenient_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.derive(fixtures.table(spark, sf_dir, "events"), _RAW_CELLS)
    return (
        quality.decode_lenient(raw)
        .groupBy("provider")
        .agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    )


@query(
    "r2_bad_cells",
    f"""WITH raw AS ({fixtures.columns_sql(_RAW_CELLS, 'events')}) SELECT id, 'input_tokens' AS "column",
      input_tokens AS cell FROM raw WHERE input_tokens IS NOT NULL AND TRY_CAST(input_tokens AS BIGINT) IS NULL""",
)
def bad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bad_cells(fixtures.derive(fixtures.table(spark, sf_dir, "events"), _RAW_CELLS))


@query(
    "r2_strict_decode",
    f"""WITH raw AS ({fixtures.columns_sql(_RAW_CELLS, 'events')}) SELECT count(*) AS calls,
      count(*) FILTER (bad) AS bad_calls, count(*) FILTER (bad) AS bad_cells,
      count(*) FILTER (bad) = 0 AS accepted
    FROM (SELECT input_tokens IS NOT NULL AND TRY_CAST(input_tokens AS BIGINT) IS NULL AS bad FROM raw)""",
)
def strict_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.strict_verdict(fixtures.derive(fixtures.table(spark, sf_dir, "events"), _RAW_CELLS))


@query(
    "r2_bad_rows",
    f"""WITH raw AS ({fixtures.columns_sql(_RAW_CELLS, 'events')}) SELECT id, input_tokens
    FROM raw WHERE input_tokens IS NOT NULL AND TRY_CAST(input_tokens AS BIGINT) IS NULL""",
)
def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.derive(fixtures.table(spark, sf_dir, "events"), _RAW_CELLS)
    return quality.bad_rows(raw).select("id", "input_tokens")
