"""Employee state, deduction and tax state, and the small statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywright.functions.aggregates import latest, latest_present, latest_rows
from paywright.functions.labels import pay_type_label
from paywright.functions.scalars import exact_sum
from paywright.sources.event_log import with_fields

INFO_COLUMNS = [
    "first_name", "last_name", "email", "pay_type", "pay_rate", "pay_period_hours", "is_active", "hire_date",
]


def info_partials(info_events: DataFrame) -> DataFrame:
    """Per employee, the latest value of every column that is not NULL together with its offset.

    Partials of disjoint sets of events merge in any order.
    """
    off = F.col("off")
    kept = {**{c: c for c in INFO_COLUMNS}, "event_type": "last_event_type"}
    return (
        info_events.filter(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(
            *[
                F.max_by(F.struct(off.alias("off"), F.col(c).alias("v")), F.when(F.col(c).isNotNull(), off)).alias(name)
                for c, name in kept.items()
            ]
        )
    )


def merge_info_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("employee_id").agg(
        *[F.max_by(F.col(c), F.col(f"{c}.off")).alias(c) for c in [*INFO_COLUMNS, "last_event_type"]]
    )


def info_from_partials(partials: DataFrame) -> DataFrame:
    """Employee table from merged partials, one per employee."""
    return partials.select("employee_id", *[F.col(f"{c}.v").alias(c) for c in [*INFO_COLUMNS, "last_event_type"]])


def employee_info(info_events: DataFrame) -> DataFrame:
    """Current fields of each employee: the latest value of every column that is not NULL.

    A single aggregation, so it also runs on a stream in update mode.
    """
    off = F.col("off")
    columns = {**{c: c for c in INFO_COLUMNS}, "event_type": "last_event_type"}
    return (
        info_events.filter(F.col("employee_id").isNotNull())
        .groupBy("employee_id")
        .agg(*[latest_present(F.col(c), off).alias(name) for c, name in columns.items()])
    )


def tax_state(tax_events: DataFrame) -> DataFrame:
    """Latest tax settings per employee."""
    return latest_rows(tax_events, ["employee_id"])


def deduction_state(deduction_events: DataFrame, with_offset: bool = False) -> DataFrame:
    """State of each deduction: ended ones keep the amount they had, an unknown one that ends has amount 0.

    With ``with_offset`` the rows carry their last offset and can stand in for the events they were made of.
    """
    off = F.col("off")
    return deduction_events.groupBy("employee_id", "deduction_id").agg(
        F.coalesce(latest_present(F.col("amount"), off), F.lit(0.0)).alias("amount"),
        F.coalesce(latest_present(F.col("is_percentage"), off), F.lit(False)).alias("is_percentage"),
        latest(F.col("is_active"), off).alias("is_active"),
        *([F.max(off).alias("off")] if with_offset else []),
    )


def deduction_totals(state: DataFrame) -> DataFrame:
    """Active fixed amounts, and active percentages as a fraction of gross, per employee."""
    fixed = F.when(F.col("is_active") & ~F.col("is_percentage"), F.col("amount"))
    share = F.when(F.col("is_active") & F.col("is_percentage"), F.col("amount") / 100.0)
    return state.groupBy("employee_id").agg(
        exact_sum(fixed).alias("fixed_total"), exact_sum(share).alias("percent_share")
    )


def active_deduction_count(deductions: DataFrame) -> DataFrame:
    return deductions.groupBy("employee_id").agg(F.count_if("is_active").alias("active_deductions"))


def deactivated_employees(events: DataFrame) -> DataFrame:
    """Every employee that was ever deactivated; no later event takes one off the list."""
    hit = with_fields(events, "Id").filter((F.col("event_type") == "employee.deactivated") & F.col("Id").isNotNull())
    return hit.select(F.col("Id").alias("employee_id")).distinct()


def replay_stats(raw: DataFrame, events: DataFrame) -> DataFrame:
    """One row: records, creations, deactivations and distinct deactivated employees of a full replay."""
    kinds = ["employee.created", "employee.deactivated"]
    rows = with_fields(events, "Id").filter(F.col("event_type").isin(kinds))
    gone = (F.col("event_type") == "employee.deactivated") & F.col("Id").isNotNull()
    per_employee = rows.groupBy(F.when(gone, F.col("Id")).alias("id")).agg(
        F.count_if(F.col("event_type") == "employee.created").alias("created"), F.count_if(gone).alias("deactivated")
    )
    counts = per_employee.agg(
        F.coalesce(F.sum("created"), F.lit(0)).alias("created"),
        F.coalesce(F.sum("deactivated"), F.lit(0)).alias("deactivated"),
        F.count("id").alias("deactivated_employees"),
    )
    total = raw.agg(F.count(F.lit(1)).alias("n"))
    return counts.select(total.scalar().alias("total_records"), "created", "deactivated", "deactivated_employees")


def directory_stats(employees: DataFrame) -> DataFrame:
    """One row: total, active, hourly and salaried employees."""
    label = pay_type_label(F.col("pay_type"))
    return employees.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_active")).alias("active"),
        F.count_if(label == "Hourly").alias("hourly"),
        F.count_if(label == "Salary").alias("salaried"),
    )


def total_hours(time_entries: DataFrame) -> DataFrame:
    return time_entries.groupBy("employee_id").agg(F.round(F.sum("hours_worked"), 2).alias("total_hours"))


def clocked_in(time_entries: DataFrame) -> DataFrame:
    """Whether each employee has an entry that is still open."""
    return time_entries.groupBy("employee_id").agg(F.bool_or(F.col("clock_out").isNull()).alias("clocked_in"))
