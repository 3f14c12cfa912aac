"""Admission checks of incoming rows, each splitting a DataFrame into accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywright.functions.ordered import BLOCK_ROWS, Running, with_running
from paywright.functions.skew import join_one_per_key
from paywright.operators.extract import hours_worked


def check_reference(rows: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Add ``accepted``: whether the row's parent existed when the row arrived.

    ``parents`` holds the events that create a parent, with their ``off``, and may repeat a key. With a row's own id as key
    and the events that create such rows as parents, this is the check of updates and deactivations for their target.
    """
    known = parents.groupBy(F.col(parent_key or key).alias(key)).agg(F.min("off").alias("_since"))
    joined = join_one_per_key(rows, known, [key])
    return joined.select(*rows.columns, F.coalesce(F.col("off") > F.col("_since"), F.lit(False)).alias("accepted"))


def check_first_per_key(rows: DataFrame, key: str, existing: DataFrame | None = None) -> DataFrame:
    """Add ``accepted``: only the first row of a key, and none where ``existing`` has the key already."""
    first = rows.groupBy(key).agg(F.min("off").alias("_first"))
    if existing is not None:
        taken = existing.select(key).distinct()
        first = first.join(taken, key, "left_anti")
    joined = join_one_per_key(rows, first, [key])
    return joined.select(*rows.columns, F.coalesce(F.col("off") == F.col("_first"), F.lit(False)).alias("accepted"))


def check_clock_events(
    events: DataFrame, open_before: DataFrame | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``accepted`` to clock events (off, employee_id, action 'in' or 'out').

    One may clock in only when not clocked in and out only when clocked in. Whether or not an event is accepted, the
    employee is clocked in after an 'in' and not after an 'out', so the previous event alone decides.
    ``open_before`` lists employees with an open entry at the start.
    """
    previous = {"_previous": Running("last", F.col("action"))}
    rows = with_running(events, ["employee_id"], previous, block_rows=block_rows)
    if open_before is not None:
        opened = open_before.select("employee_id").distinct().withColumn("_open", F.lit("in"))
        rows = join_one_per_key(rows, opened, ["employee_id"]).withColumn("_previous", F.coalesce("_previous", "_open"))
    inside = F.coalesce(F.col("_previous") == "in", F.lit(False))
    return rows.select(*events.columns, F.when(F.col("action") == "in", ~inside).otherwise(inside).alias("accepted"))


def check_hours(entries: DataFrame, clock_in: str = "clock_in", clock_out: str = "clock_out") -> DataFrame:
    """Add ``hours_worked`` and ``rejected``: a clock-out must come after its clock-in."""
    wrong = F.coalesce(F.col(clock_out) <= F.col(clock_in), F.lit(False))
    hours = F.when(~wrong, hours_worked(F.col(clock_in), F.col(clock_out)))
    return entries.withColumns({"hours_worked": hours, "rejected": wrong})
