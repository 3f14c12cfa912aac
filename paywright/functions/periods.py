"""Fourteen-day pay periods counted from Monday 2024-01-01T00:00:00Z (session time zone UTC)."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PERIOD_ZERO_MS = 1704067200000
PERIOD_MS = 1209600000
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def parse_iso(text: Column) -> Column:
    """The first 19 characters as a timestamp; fractions and zone suffix are cut off, junk is NULL."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit(ISO_SECONDS))


def period_of(ts: Column) -> Column:
    """Integer period number. ``div`` truncates to zero, so the fourteen days before period zero are 0 as well."""
    return F.call_function("div", F.unix_millis(ts) - F.lit(PERIOD_ZERO_MS), F.lit(PERIOD_MS))


def period_of_text(text: Column) -> Column:
    return period_of(parse_iso(text))


def period_start(period: Column) -> Column:
    return _format(period)


def period_end(period: Column) -> Column:
    return _format(period + F.lit(1))


def _format(period: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.lit(PERIOD_ZERO_MS) + period * F.lit(PERIOD_MS)), ISO_SECONDS)


def tumbling_window(ts: Column) -> Column:
    """The same buckets as Spark windows (2024-01-01 lies 11 days into the 14-day grid that starts at the epoch)."""
    return F.window(ts, "14 days", startTime="11 days")


def period_at(now: datetime) -> int:
    """Current period for a caller-supplied clock."""
    moment = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    millis = int(moment.timestamp() * 1000)
    return int((millis - PERIOD_ZERO_MS) / PERIOD_MS)
