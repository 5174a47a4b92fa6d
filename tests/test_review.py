from datetime import datetime, timedelta

import frames
import pytest
from pyspark.sql import functions as F

from spendlens.operators import gaps, review, stats, tail
from spendlens.functions import text

START = datetime(2026, 7, 20, 10)


def at(seconds):
    return str(START + timedelta(seconds=seconds))


def test_gap_buckets_across_slices(spark):
    """Gaps shorter and longer than a slice, ties, and calls without input tokens."""
    seconds = [0, 10, 10, 290, 301, 700, 2000, 6000]
    calls = [{"ts": at(s), "input_tokens": 1, "provider": p} for p in "ab" for s in seconds]
    calls.append({"ts": at(11), "input_tokens": 0, "provider": "a"})
    got = gaps.idle_gaps(frames.calls(spark, calls)).orderBy("provider", "ts", "id").collect()
    expected = [(10, "<30s"), (0, "<30s"), (280, "30s-5m"), (11, "<30s"), (399, "5-15m"),
                (1300, "15-60m"), (4000, ">1h")]
    assert [(r.gap_s, r.gap_bucket) for r in got] == expected * 2


def test_cache_decay_uses_whole_prompt_for_additive_models(spark):
    calls = [
        {"ts": at(0), "provider": "anthropic", "model": "claude-sonnet-4-5", "input_tokens": 1},
        {"ts": at(60), "provider": "anthropic", "model": "claude-sonnet-4-5", "input_tokens": 100,
         "cache_read_input_tokens": 300},
    ]
    row = review.cache_decay(frames.calls(spark, calls), frames.prices(spark)).first()
    assert (row.bucket, row.n, row.hit_pct, row.prompt_hit_pct) == ("30s-5m", 1, 300.0, 75.0)


def test_bursts(spark):
    def burst(client, start, counts, step=20):
        order = [m for m, n in counts.items() for _ in range(n)]
        return [{"ts": at(start + i * step), "client": client, "model": m} for i, m in enumerate(order)]

    calls = (
        burst("eval", 0, {"a": 5, "b": 5, "c": 5})
        + burst("eval", 5000, {"a": 2, "b": 2})  # too few models
        + burst("eval", 9000, {"a": 1, "b": 1, "c": 1}, step=301)  # not one session
        + burst("agent", 0, {"a": 9, "b": 2, "c": 1})  # unequal
    )
    got = review.evaluation_bursts(frames.calls(spark, calls), idle_seconds=300).collect()
    assert [(r.src, r.models, r.calls_per_model) for r in got] == [("eval", 3, 5)]
    assert got[0].ended - got[0].started == timedelta(seconds=14 * 20)


def test_percentiles_are_nearest_rank(spark):
    calls = [{"provider": "five", "latency_ms": v} for v in (100, 200, 300, 400, 1000)]
    calls += [{"provider": "one", "latency_ms": 42}]
    calls += [{"provider": "many", "latency_ms": v} for v in range(1, 201)]
    got = stats.grouped_stats(frames.calls(spark, calls), frames.no_prices(spark)).collect()
    assert {r.provider: (r.p50_ms, r.p95_ms) for r in got} == {
        "five": (300, 1000), "one": (42, 42), "many": (100, 190),
    }
    assert [r.provider for r in got] == ["five", "many", "one"]


@pytest.mark.parametrize("n", range(1, 45, 4))
def test_percentile_ranks(spark, n):
    calls = [{"latency_ms": 7 * v} for v in range(1, n + 1)]
    row = stats.grouped_stats(frames.calls(spark, calls), frames.no_prices(spark)).first()
    assert (row.p50_ms, row.p95_ms) == (7 * -(-n * 50 // 100), 7 * -(-n * 95 // 100))


def test_unknown_grouping_is_refused(spark):
    with pytest.raises(ValueError):
        stats.grouped_stats(frames.calls(spark, []), frames.no_prices(spark), "colour")


def test_cache_pct_needs_reads_and_a_denominator(spark):
    frame = frames.rows(
        spark, [{"r": 50, "d": 100}, {"r": 0, "d": 100}, {"r": 50, "d": 0}], "r bigint, d bigint"
    )
    got = frame.selectExpr(f"{stats.cache_pct('r', 'd')} AS p").collect()
    assert [r.p for r in got] == [50.0, None, None]


def test_tail_takes_the_last_inserted_and_shows_them_in_order(spark):
    calls = frames.calls(
        spark, [{"ts": at(-i), "model": "gpt-4o", "input_tokens": 1} for i in range(30)]
    ).withColumn("ingest_seq", F.col("id").cast("bigint"))
    got = tail.tail(calls, frames.prices(spark), n=4).collect()
    assert [r.ingest_seq for r in got] == [26, 27, 28, 29]


def test_labels(spark):
    listing = tail.priced_listing(
        frames.calls(
            spark,
            [
                {"provider": "anthropic", "model": "claude-sonnet-4-5", "status": 429, "latency_ms": 820,
                 "client": "opencode/0.4 (x; y)"},
                {"status": 200, "input_tokens": 16200, "cache_read_input_tokens": 45200, "cost": 0.1132},
                {"error_kind": "upstream_tls", "anomaly": "no_usage"},
                {"status": 503, "output_tokens": 4},
            ],
        ).withColumn("ingest_seq", F.col("id").cast("bigint")),
        frames.prices(spark),
    )
    got = [r.line for r in tail.lines(listing).orderBy("ingest_seq").collect()]
    assert got == [
        "[2026-07-20T10:00:00Z] anthropic claude-sonnet-4-5 429 820ms tokens=? $0.0000 "
        "ERROR=rate_limit client=opencode/0.4",
        "[2026-07-20T10:00:00Z] openai ? 200 100ms tokens=16200→? cache_read=45200 $0.1132",
        "[2026-07-20T10:00:00Z] openai ? err 100ms tokens=? ERROR=upstream_tls ANOMALY=no_usage",
        "[2026-07-20T10:00:00Z] openai ? 503 100ms tokens=? ERROR=http_503",
    ]


def test_short_texts(spark):
    values = ["a" * 48, "a" * 49, "é" * 60, "  lead ing", "   ", "x" * 50]
    frame = frames.rows(spark, [{"i": i, "t": t} for i, t in enumerate(values)], "i int, t string")
    got = frame.select(
        text.display_key(F.col("t")).alias("k"), text.short_client(F.col("t")).alias("c")
    ).collect()
    assert [r.k for r in got][:3] == ["a" * 48, "a" * 48 + "…", "é" * 48 + "…"]
    assert [r.c for r in got][3:] == ["lead", "   ", "x" * 40]


def test_gaps_never_window_a_whole_provider(spark):
    calls = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "CAST(event_id AS STRING) AS id", "ts", "event_type AS provider", "event_id AS input_tokens"
    )
    plan = gaps.idle_gaps(calls)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    by_row = [w for w in windows if "lag(ts" in w]
    assert all("_slice" in w.split("], [")[1] for w in by_row) and len(by_row) == 1
