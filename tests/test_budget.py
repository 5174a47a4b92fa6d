from datetime import datetime, timezone

import frames
import pytest

from spendlens.operators.budget import budget_check, budget_line, parse_budget, spend
from spendlens.operators.quality import decode_lenient, decode_strict
from spendlens.timebounds import from_bound

NOW = datetime(2026, 7, 20, 18, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "spec, expected",
    [
        ("50", (50.0, "day")),
        ("50/day", (50.0, "day")),
        (" 300 / 7d ", (300.0, "7d")),
        ("500/month", (500.0, "month")),
        ("12.50/week", (12.5, "week")),
    ],
)
def test_parse_budget(spec, expected):
    assert parse_budget(spec) == expected


@pytest.mark.parametrize("spec", ["0", "-5", "abc", "", "nan", "inf", "50/", "1_000", "nonsense"])
def test_parse_budget_rejects(spec):
    with pytest.raises(ValueError):
        parse_budget(spec)


TOKENS = {"input_tokens": 100, "output_tokens": 50}
KNOWN = {"model": "gpt-x", "cost": 2.0} | TOKENS
UNKNOWN = {"model": "unknown-model"} | TOKENS


@pytest.mark.parametrize(
    "calls, spec, status",
    [
        ([KNOWN], "3/2020-01-01", "ok"),
        ([KNOWN], "2/2020-01-01", "over"),
        ([KNOWN], "1/2020-01-01", "over"),
        ([UNKNOWN], "3/2020-01-01", "unknown"),
        ([KNOWN, UNKNOWN], "1/2020-01-01", "over"),
        ([], "3/day", "ok"),
    ],
)
def test_verdicts(spark, calls, spec, status):
    checked = budget_check(frames.calls(spark, calls), frames.no_prices(spark), spec, NOW).first()
    assert checked.status == status
    assert checked.unpriced_calls == calls.count(UNKNOWN)
    assert checked.spent == 2.0 * calls.count(KNOWN)


def test_spend_in_window(spark):
    calls = frames.calls(
        spark,
        [
            {"model": "gpt-x", "cost": 0.12} | TOKENS,
            {"model": "mystery"} | TOKENS,
            {"model": None, "input_tokens": 0, "output_tokens": 0},
            {"ts": "2026-07-01 09:00:00", "model": "gpt-x", "cost": 5.0} | TOKENS,
        ],
    )
    recent = from_bound(calls, datetime(2026, 7, 15, tzinfo=timezone.utc))
    row = spend(recent, frames.no_prices(spark)).first()
    assert (row.spent, row.unpriced_calls) == (0.12, 1)


def test_line(spark):
    calls = frames.calls(spark, [{"model": "gpt-x", "cost": 14.2} | TOKENS])
    lines = [
        budget_line(budget_check(calls, frames.no_prices(spark), spec, NOW)).first().line
        for spec in ("50/day", "10/day")
    ]
    assert lines == ["day: $14.20 / $50.00 (28%) — ok", "day: $14.20 / $10.00 (142%) — OVER by $4.20"]


def test_strict_and_lenient_decoding(spark):
    raw = frames.rows(
        spark,
        [{"id": "a", "input_tokens": "not-an-integer"}, {"id": "b", "input_tokens": "7"}, {"id": "c"}],
        "id string, input_tokens string",
    )
    assert [r.id for r in decode_lenient(raw).orderBy("id").collect()] == ["b", "c"]
    with pytest.raises(Exception, match="not-an-integer"):
        decode_strict(raw).collect()
