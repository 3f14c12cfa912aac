"""Projections of events (off, data) into typed streams and entity tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywright.functions import periods
from paywright.functions.aggregates import latest_rows
from paywright.functions.scalars import as_double, as_flag
from paywright.sources.event_log import with_fields

# Fixed value: the entry id under which rate changes are counted.
RATE_ENTRY = "__PAY_RATE__"


def _text(name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(as_double(F.col(name)), F.lit(default))


def employee_info_events(events: DataFrame) -> DataFrame:
    """Employee fields of every ``employee.*`` event."""
    names = ["Id", "FirstName", "LastName", "Email", "PayType", "PayRate", "PayPeriodHours", "IsActive", "HireDate"]
    return with_fields(events, *names).filter(F.col("event_type").startswith("employee.")).select(
        "off",
        F.col("Id").alias("employee_id"),
        F.col("FirstName").alias("first_name"),
        F.col("LastName").alias("last_name"),
        F.col("Email").alias("email"),
        F.col("PayType").alias("pay_type"),
        as_double(F.col("PayRate")).alias("pay_rate"),
        as_double(F.col("PayPeriodHours")).alias("pay_period_hours"),
        F.col("IsActive").alias("is_active"),
        F.col("HireDate").alias("hire_date"),
        "event_type",
    )


def time_entry_events(events: DataFrame) -> DataFrame:
    """Clock-outs and edits; the clock-in decides the pay period."""
    rows = with_fields(events, "Id", "EmployeeId", "HoursWorked", "ClockIn", "ClockOut")
    return rows.filter(F.col("event_type").isin("timeentry.clockedout", "timeentry.updated")).select(
        "off",
        F.col("Id").alias("time_entry_id"),
        F.col("EmployeeId").alias("employee_id"),
        as_double(F.col("HoursWorked")).alias("hours_worked"),
        F.col("ClockIn").alias("clock_in_time"),
        F.col("ClockOut").alias("clock_out_time"),
        periods.period_of_text(F.col("ClockIn")).alias("pay_period_number"),
    )


def gross_pay_events(events: DataFrame) -> DataFrame:
    """Rate changes and time entries in one shape; a rate change is a zero-hour entry under a reserved id."""
    kinds = ["employee.created", "employee.updated", "timeentry.clockedout", "timeentry.updated"]
    rows = with_fields(
        events, "Id", "EmployeeId", "HoursWorked", "PayRate", "PayType", "PayPeriodHours", "ClockIn", "UpdatedAt"
    )
    return rows.filter(F.col("event_type").isin(kinds)).select(
        "off",
        F.coalesce(F.col("EmployeeId"), F.col("Id")).alias("employee_id"),
        F.when(F.col("event_type").startswith("timeentry."), F.col("Id"))
        .otherwise(F.lit(RATE_ENTRY))
        .alias("time_entry_id"),
        _number("HoursWorked").alias("hours_worked"),
        as_double(F.col("PayRate")).alias("pay_rate"),
        F.col("PayType").alias("pay_type"),
        as_double(F.col("PayPeriodHours")).alias("pay_period_hours"),
        periods.period_of_text(F.coalesce(F.col("ClockIn"), F.col("UpdatedAt"))).alias("pay_period_number"),
    )


def branch_of(event_type: Column) -> Column:
    """Which handler of the net-pay job an event belongs to."""
    return (
        F.when(event_type == "employee.deactivated", F.lit("deactivated"))
        .when(event_type.startswith("taxinfo."), F.lit("tax"))
        .when(event_type.startswith("deduction."), F.lit("deduction"))
        .otherwise(F.lit("ignored"))
    )


def demux(events: DataFrame) -> dict[str, DataFrame]:
    """One filtered DataFrame per branch; null event names belong to none."""
    named = with_fields(events, "Id", "EmployeeId").filter(F.col("event_type").isNotNull())
    named = named.withColumn("branch", branch_of(F.col("event_type")))
    return {
        name: named.filter(F.col("branch") == name).drop("branch")
        for name in ("deactivated", "tax", "deduction", "ignored")
    }


def tax_events(events: DataFrame) -> DataFrame:
    rows = with_fields(
        events, "EmployeeId", "FederalFilingStatus", "State", "AdditionalFederalWithholding", "AdditionalStateWithholding"
    )
    return rows.filter(F.col("event_type").startswith("taxinfo.") & F.col("EmployeeId").isNotNull()).select(
        "off",
        F.col("EmployeeId").alias("employee_id"),
        _text("FederalFilingStatus", "Single").alias("federal_filing_status"),
        _text("State", "").alias("state"),
        _number("AdditionalFederalWithholding").alias("additional_federal_withholding"),
        _number("AdditionalStateWithholding").alias("additional_state_withholding"),
    )


def deduction_events(events: DataFrame) -> DataFrame:
    keyed = with_fields(events, "Id", "EmployeeId", "Amount", "IsPercentage", "IsActive").filter(
        F.col("event_type").startswith("deduction.") & F.col("EmployeeId").isNotNull() & F.col("Id").isNotNull()
    )
    ended = F.col("event_type") == "deduction.deactivated"
    return keyed.select(
        "off",
        F.col("EmployeeId").alias("employee_id"),
        F.col("Id").alias("deduction_id"),
        "event_type",
        F.when(~ended, _number("Amount")).alias("amount"),
        F.when(~ended, as_flag(F.col("IsPercentage"), False)).alias("is_percentage"),
        (~ended & as_flag(F.col("IsActive"), True)).alias("is_active"),
    )


def gross_defaults(gross: DataFrame) -> DataFrame:
    """Gross-pay rows as the net-pay job reads them: absent numbers are 0, an absent pay type is '1'."""
    fills = {
        "pay_rate": F.lit(0.0), "gross_pay": F.lit(0.0), "total_hours_worked": F.lit(0.0),
        "pay_type": F.lit("1"), "pay_period_start": F.lit(""), "pay_period_end": F.lit(""),
    }
    return gross.withColumns({c: F.coalesce(F.col(c), default) for c, default in fills.items()})


# Entity tables -------------------------------------------------------------------------------------------------------


def _entities(events: DataFrame, prefix: str, columns: dict[str, Column]) -> DataFrame:
    """Newest state per entity id; ``columns`` maps payload fields to the columns read from them."""
    rows = with_fields(events, *columns).filter(F.col("event_type").startswith(prefix) & F.col("Id").isNotNull())
    typed = rows.select("off", *[c.alias(_snake(name)) for name, c in columns.items()])
    return latest_rows(typed, ["id"]).drop("off")


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


def _as(kind: str, *names: str) -> dict[str, Column]:
    return {name: F.col(name).try_cast(kind) for name in names}


_AUDIT = ("CreatedAt", "UpdatedAt")
_MONEY = "decimal(18,2)"


def employees(events: DataFrame) -> DataFrame:
    hours = F.coalesce(F.col("PayPeriodHours").try_cast(_MONEY), F.lit(40).cast(_MONEY))
    return _entities(events, "employee.", {
        **_as("string", "Id", "FirstName", "LastName", "Email"),
        **_as("int", "PayType"),
        **_as(_MONEY, "PayRate"),
        "PayPeriodHours": hours,
        **_as("timestamp", "HireDate"),
        "IsActive": as_flag(F.col("IsActive"), True),
        **_as("timestamp", *_AUDIT),
    })


def time_entries(events: DataFrame) -> DataFrame:
    return _entities(events, "timeentry.", {
        **_as("string", "Id", "EmployeeId"),
        **_as("timestamp", "ClockIn", "ClockOut"),
        **_as(_MONEY, "HoursWorked"),
        **_as("timestamp", *_AUDIT),
    })


def tax_information(events: DataFrame) -> DataFrame:
    return _entities(events, "taxinfo.", {
        **_as("string", "Id", "EmployeeId", "FederalFilingStatus"),
        **_as("int", "FederalAllowances"),
        **_as(_MONEY, "AdditionalFederalWithholding"),
        **_as("string", "State", "StateFilingStatus"),
        **_as("int", "StateAllowances"),
        **_as(_MONEY, "AdditionalStateWithholding"),
        **_as("timestamp", *_AUDIT),
    })


def deductions(events: DataFrame) -> DataFrame:
    return _entities(events, "deduction.", {
        **_as("string", "Id", "EmployeeId"),
        **_as("int", "DeductionType"),
        **_as("string", "Description"),
        **_as(_MONEY, "Amount"),
        "IsPercentage": as_flag(F.col("IsPercentage"), False),
        "IsActive": as_flag(F.col("IsActive"), True),
        **_as("timestamp", *_AUDIT),
    })


def hours_worked(clock_in: Column, clock_out: Column) -> Column:
    """Hours between two timestamps, half-even to cents; 0 while the entry is open.

    Counted in whole hundredths of an hour with the remainder in microseconds, so the tie is exact and stays in long
    arithmetic.
    """
    hundredth = F.lit(36_000_000)
    micros = F.unix_micros(clock_out) - F.unix_micros(clock_in)
    whole, rest = F.call_function("div", micros, hundredth), micros % hundredth
    up = (rest * 2 > hundredth) | ((rest * 2 == hundredth) & (whole % 2 == 1))
    rounded = whole + F.when(up, 1).otherwise(0)
    hours = (rounded.cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")
    return F.coalesce(hours, F.lit(0).cast("decimal(18,2)"))
