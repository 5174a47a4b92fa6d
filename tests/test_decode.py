"""Quarantine of bad cells, values written back, sketches, summaries."""

from datetime import datetime, timezone

import frames
import pytest
from pyspark.sql import functions as F

from spendlens.operators import quality, sketches, stats
from spendlens.sources import calls as store
from spendlens.sources import prices as price_source
from spendlens.timebounds import is_bound


def test_quarantine_names_every_bad_cell(spark):
    rows = [{"id": "a", "status": "200", "latency_ms": "5"}, {"id": "b", "status": "x", "latency_ms": "1.5s"}, {"id": "c"}]
    raw = frames.rows(spark, rows, "id string, status string, latency_ms string")
    good, bad = quality.quarantined(raw)
    assert sorted((r.id, r.status) for r in good.collect()) == [("a", 200), ("c", None)]
    assert [(r.id, r.cells) for r in bad.collect()] == [("b", ["status", "latency_ms"])]
    assert sorted((r.id, r.column, r.cell) for r in quality.bad_cells(raw).collect()) == [("b", "latency_ms", "1.5s"), ("b", "status", "x")]
    assert tuple(quality.strict_verdict(raw).first()) == (3, 1, 2, False)
    assert tuple(quality.strict_verdict(raw.where("id <> 'b'")).first()) == (2, 0, 0, True)
    assert tuple(quality.strict_verdict(raw.limit(0)).first()) == (0, 0, 0, True)


def test_write_back_touches_only_dates_that_change(spark, tmp_path):
    path = str(tmp_path / "calls")
    raw = '{"prompt_tokens":7,"completion_tokens":2}'
    rows = [
        {"id": "a", "ts": "2026-07-20 10:00:00", "raw_usage": raw},
        {"id": "b", "ts": "2026-07-20 11:00:00", "input_tokens": 9},
        {"id": "c", "ts": "2026-07-21 10:00:00", "raw_usage": raw, "input_tokens": 7, "output_tokens": 2},
    ]
    store.append_calls(frames.calls(spark, rows).withColumn("ingest_seq", F.col("latency_ms")), path)
    before = set(spark.read.parquet(path).inputFiles())
    assert [str(d) for d in store.write_back(spark, path)] == ["2026-07-20"]
    after = set(spark.read.parquet(path).inputFiles())
    assert {f for f in before if "dt=2026-07-21" in f} <= after and not {f for f in before if "dt=2026-07-20" in f} & after
    stored = store.read_calls(spark, path)
    assert sorted((r.id, r.input_tokens, r.output_tokens, r.ingest_seq) for r in stored.collect()) == [
        ("a", 7, 2, 100), ("b", 9, None, 100), ("c", 7, 2, 100)
    ]
    assert store.write_back(spark, path) == []
    assert set(spark.read.parquet(path).inputFiles()) == after


def test_sketches_of_days_merge(spark):
    rows = [{"ts": f"2026-07-{1 + i % 5:02d} 10:00:00", "latency_ms": i, "provider": "p" if i % 3 else "q"} for i in range(3000)]
    calls = frames.calls(spark, rows)
    daily = sketches.latency_sketches(calls)
    assert daily.count() == 10
    read = sketches.percentiles(daily)
    checked = {r.provider: r for r in sketches.within_error(read, calls).collect()}
    assert checked["p"].timed == 2000 and checked["q"].timed == 1000
    assert all(r.p50_ms_ok and r.p95_ms_ok for r in checked.values())
    wrong = read.withColumn("p50_ms", F.col("p50_ms") + 400)
    assert not any(r.p50_ms_ok for r in sketches.within_error(wrong, calls).collect())


@pytest.mark.parametrize("age, text", [(None, "no price table found"), (0, "price table pulled today"), (9, "price table is 9 days old")])
def test_unpriced_summary(spark, age, text):
    models = ["x"] * 3 + ["y"] * 3 + ["z"] * 2 + ["w"] + ["gpt-4o"]
    calls = frames.calls(spark, [{"model": m, "input_tokens": 1} for m in models])
    row = stats.unpriced_summary(calls, frames.prices(spark), age).first()
    assert tuple(row) == (9, "x (3), y (3), z (2)", text)
    assert stats.unpriced_summary(calls.where("model = 'gpt-4o'"), frames.prices(spark), age).count() == 0


def test_no_price_file(spark, tmp_path):
    now = datetime.now(timezone.utc)
    assert price_source.show_prices(spark, str(tmp_path / "none.json"), now).collect() == []
    texts = frames.rows(spark, [{"source": "a", "value": "{"}, {"source": "b", "value": "{}"}, {"source": "c", "value": None}], "source string, value string")
    assert sorted(r.warning for r in price_source.malformed_prices(texts).collect()) == ["ignoring malformed a", "ignoring malformed c"]


def test_bounds_as_data(spark):
    texts = ["7d", "today", "2026-07", "2026-07-01T00:00:00+02:00", "7w", "", "tomorrow", "2026-07-01T00:00:00", None, "-3h"]
    frame = frames.rows(spark, [{"s": t} for t in texts], "s string")
    assert [r.a for r in frame.select(is_bound(F.col("s")).alias("a")).collect()] == [True] * 4 + [False] * 6
