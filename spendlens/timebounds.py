"""Lower time bounds from short texts, relative to a given ``now`` and zone."""

from __future__ import annotations

import re
from bisect import bisect_left
from datetime import date, datetime, time, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTC = timezone.utc


def _zone(tz: str | tzinfo) -> tzinfo:
    return ZoneInfo(tz) if isinstance(tz, str) else tz


def _local_midnight(day: date, tz: tzinfo) -> datetime:
    return datetime.combine(day, time(), tz).astimezone(UTC)


def _first_date_from(prefix: str) -> datetime:
    """The first UTC midnight whose ISO text does not sort before ``prefix``."""
    days = range(1, date.max.toordinal() + 1)
    at = bisect_left(days, prefix, key=lambda n: date.fromordinal(n).isoformat())
    if at == len(days):
        return datetime.max.replace(tzinfo=UTC)
    return datetime.combine(date.fromordinal(days[at]), time(), UTC)


def since_bound(spec: str, now: datetime, tz: str | tzinfo = "UTC") -> datetime:
    """``30m``, ``12h``, ``7d``, ``today``, an RFC-3339 instant or a date prefix, as UTC.

    Minutes and hours are elapsed time; days are calendar days in ``tz``; a date
    prefix such as ``2026-07`` starts at UTC midnight.
    """
    text, zone = spec.strip(), _zone(tz)
    local = now.astimezone(zone)
    if text.lower() == "today":
        return _local_midnight(local.date(), zone)
    if relative := re.fullmatch(r"([0-9]+)([mhd])", text):
        amount, unit = int(relative[1]), relative[2]
        try:
            if unit == "d":
                return (local - timedelta(days=amount)).astimezone(UTC)
            return now.astimezone(UTC) - timedelta(**{{"m": "minutes", "h": "hours"}[unit]: amount})
        except OverflowError as e:
            raise ValueError(f"time bound {spec!r} is out of range") from e
    if "T" in text or ":" in text:
        try:
            instant = datetime.fromisoformat(text)
        except ValueError as e:
            raise ValueError(f"{spec!r} is not an RFC-3339 instant") from e
        if instant.tzinfo is None:
            raise ValueError(f"{spec!r} has no UTC offset")
        return instant.astimezone(UTC)
    if len(text) >= 4 and re.fullmatch(r"[0-9-]+", text):
        return _first_date_from(text[:10])
    raise ValueError(
        f"bad time bound {spec!r}: expected 30m, 12h, 7d, today, 2026-07-01 or an instant"
    )


def is_bound(spec: Column) -> Column:
    """Whether each text is one that ``since_bound`` accepts; the texts do not depend on ``now``."""

    @F.pandas_udf("boolean")
    def accepted(specs: pd.Series) -> pd.Series:
        now = datetime(2024, 1, 1, tzinfo=UTC)

        def good(text: str | None) -> bool:
            try:
                return text is not None and since_bound(text, now) is not None
            except ValueError:
                return False

        return specs.map({s: good(s) for s in specs.unique()})

    return accepted(spec)


def window_bound(period: str, now: datetime, tz: str | tzinfo = "UTC") -> datetime:
    """Start of the local ``day``, ``week`` (Monday) or ``month``; else as ``since_bound``."""
    zone = _zone(tz)
    today = now.astimezone(zone).date()
    starts = {
        "day": today,
        "week": today - timedelta(days=today.weekday()),
        "month": today.replace(day=1),
    }
    if period in starts:
        return _local_midnight(starts[period], zone)
    return since_bound(period, now, tz)


def bound_literal(bound: datetime, like: T.DataType) -> Column:
    """``bound`` in the type of the column it is compared with, so the filter reaches the scan."""
    if isinstance(like, T.TimestampNTZType):
        return F.lit(bound.astimezone(UTC).replace(tzinfo=None).isoformat()).cast(like)
    return F.lit(bound)


def from_bound(calls: DataFrame, bound: datetime | None) -> DataFrame:
    """Calls at or after ``bound``; prunes the ``dt`` partitions where the table has them."""
    if bound is None:
        return calls
    kept = calls.where(F.col("ts") >= bound_literal(bound, calls.schema["ts"].dataType))
    if "dt" in calls.columns:
        kept = kept.where(F.col("dt") >= F.lit(bound.astimezone(UTC).date()))
    return kept


def since(calls: DataFrame, spec: str | None, now: datetime, tz: str | tzinfo = "UTC") -> DataFrame:
    return calls if spec is None else from_bound(calls, since_bound(spec, now, tz))
