"""Hours and gross pay per employee and pay period.

Both are two-level aggregations: first the last value of every entry (an edit replaces, it never adds), then the sum per
period. The first level is keyed by entry and combines on the map side, so neither a hot employee nor an entry edited
millions of times builds a list in memory; the second level shuffles only per-period partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywright.functions import periods
from paywright.functions.aggregates import latest
from paywright.functions.scalars import exact_sum
from paywright.operators.extract import RATE_ENTRY

PERIOD_KEYS = ["employee_id", "pay_period_number"]
ENTRY_KEYS = [*PERIOD_KEYS, "time_entry_id"]
RATE_TERMS = ["pay_rate", "pay_type", "pay_period_hours"]
# The code of salaried pay, and the hours a yearly rate is divided by.
SALARY = "2"
YEARLY_HOURS = 2080.0


def _keyed(events: DataFrame) -> DataFrame:
    """Rows whose grouping key is incomplete belong to no group."""
    return events.filter(F.col("employee_id").isNotNull() & F.col("pay_period_number").isNotNull())


def last_value_sum(df: DataFrame, keys: list[str], entry: str, value: str, offset: str = "off") -> DataFrame:
    """Sum of each entry's last value per ``keys``: columns ``keys``, ``total``, ``event_count``."""
    per_entry = df.groupBy(*keys, entry).agg(
        latest(F.col(value), F.col(offset)).alias("_value"), F.count(F.lit(1)).alias("_events")
    )
    return per_entry.groupBy(*keys).agg(
        exact_sum(F.col("_value")).alias("total"), F.sum("_events").alias("event_count")
    )


def with_period_bounds(df: DataFrame) -> DataFrame:
    number = F.col("pay_period_number")
    return df.withColumns(
        {"pay_period_start": periods.period_start(number), "pay_period_end": periods.period_end(number)}
    )


def hours_by_period(time_entry_events: DataFrame) -> DataFrame:
    """Edit-safe hours and event count per employee and period."""
    totals = last_value_sum(_keyed(time_entry_events), PERIOD_KEYS, "time_entry_id", "hours_worked")
    return with_period_bounds(totals).select(
        *PERIOD_KEYS, F.col("total").alias("total_hours_worked"), "event_count", "pay_period_start", "pay_period_end"
    )


def entry_partials(gross_pay_events: DataFrame) -> DataFrame:
    """First level: one row per employee, period and entry.

    Partials of disjoint sets of events can be merged by ``merge_partials``, in any order, which is what the streaming
    job relies on.
    """
    off = F.col("off")
    rate_terms = [
        F.max_by(F.struct(off.alias("off"), F.col(c).alias("v")), F.when(F.col(c).isNotNull(), off)).alias(c)
        for c in RATE_TERMS
    ]
    return (
        _keyed(gross_pay_events)
        .groupBy(*ENTRY_KEYS)
        .agg(
            latest(F.col("hours_worked"), off).alias("hours_worked"),
            F.max(off).alias("last_off"),
            F.count(F.lit(1)).alias("event_count"),
            *rate_terms,
        )
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of the same entry from several batches become one."""
    off = F.col("last_off")
    return partials.groupBy(*ENTRY_KEYS).agg(
        latest(F.col("hours_worked"), off).alias("hours_worked"),
        F.max(off).alias("last_off"),
        F.sum("event_count").alias("event_count"),
        *[F.max_by(F.col(c), F.col(f"{c}.off")).alias(c) for c in RATE_TERMS],
    )


def gross_from_partials(partials: DataFrame, with_hours: bool = False) -> DataFrame:
    """Second level: one row per employee and period, with the offset of the last event that shaped it.

    ``with_hours`` adds what ``hours_by_period`` counts: ``entry_hours`` and ``entry_events``, the latter 0 where the period
    has no time entry.
    """
    per_period = partials.groupBy(*PERIOD_KEYS).agg(
        *[F.max_by(F.col(f"{c}.v"), F.col(f"{c}.off")).alias(c) for c in RATE_TERMS],
        exact_sum(F.col("hours_worked")).alias("entry_hours"),
        F.sum(F.when(F.col("time_entry_id") == RATE_ENTRY, 0).otherwise(F.col("event_count"))).alias("entry_events"),
        F.sum("event_count").alias("event_count"),
        F.max("last_off").alias("last_off"),
    )
    salaried = F.coalesce(F.col("pay_type") == SALARY, F.lit(False))
    hours = F.when(salaried, F.col("pay_period_hours")).otherwise(F.col("entry_hours"))
    rate = F.when(salaried, F.col("pay_rate") / YEARLY_HOURS).otherwise(F.col("pay_rate"))
    paid = per_period.withColumns({"total_hours_worked": hours, "effective_hourly_rate": rate})
    return with_period_bounds(
        paid.withColumn("gross_pay", F.col("effective_hourly_rate") * F.col("total_hours_worked"))
    ).select(
        *PERIOD_KEYS, "pay_rate", "pay_type", "pay_period_hours", "total_hours_worked", "effective_hourly_rate",
        "gross_pay", "pay_period_start", "pay_period_end", "event_count", "last_off",
        *(["entry_hours", "entry_events"] if with_hours else []),
    )


def gross_pay_by_period(gross_pay_events: DataFrame) -> DataFrame:
    """Gross pay per employee and period.

    Rate, type and salary hours are those set *within* the period; a period without a rate event has no gross pay.
    ``last_off`` is the offset of the last contributing event.
    """
    return gross_from_partials(entry_partials(gross_pay_events))
