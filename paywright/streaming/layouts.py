"""Schemas of what the streaming jobs keep on disk."""

from __future__ import annotations

from pyspark.sql import types as T

from paywright.operators.people import INFO_COLUMNS
from paywright.schemas import NET_PAY_VALUE, PAY_PERIOD_RECORD
from paywright.streaming.store import DELETED

S, D, L, B, TS = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()
MONEY = T.DecimalType(18, 2)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def at_offset(kind: T.DataType) -> T.StructType:
    """A value with the offset it was seen at."""
    return struct(off=L, v=kind)


PARTIALS = struct(
    employee_id=S, time_entry_id=S, hours_worked=D, last_off=L, event_count=L,
    pay_rate=at_offset(D), pay_type=at_offset(S), pay_period_hours=at_offset(D), pay_period_number=L,
)
HOURS = struct(
    employee_id=S, pay_period_number=L, total_hours_worked=D, event_count=L, pay_period_start=S, pay_period_end=S
)
GROSS = struct(
    employee_id=S, pay_period_number=L, pay_rate=D, pay_type=S, pay_period_hours=D, total_hours_worked=D,
    effective_hourly_rate=D, gross_pay=D, pay_period_start=S, pay_period_end=S, event_count=L, last_off=L,
)
#: Gross pay, and the hours of the same period beside it.
PAY = T.StructType([*GROSS.fields, *struct(entry_hours=D, entry_events=L).fields])
TAX = struct(
    off=L, employee_id=S, federal_filing_status=S, state=S, additional_federal_withholding=D,
    additional_state_withholding=D,
)
DEDUCTIONS = struct(off=L, employee_id=S, deduction_id=S, amount=D, is_percentage=B, is_active=B)
#: Settings of all kinds in one table: ``kind`` is tax, deduction or gone.
SETTINGS = T.StructType([T.StructField("kind", S), *TAX.fields, *[f for f in DEDUCTIONS if f.name not in TAX.fieldNames()]])
GONE = struct(employee_id=S)
NET = T.StructType(
    [*struct(employee_id=S, pay_period_number=L), *NET_PAY_VALUE.fields, *struct(off=L, **{DELETED: B})]
)
PAY_ROWS = T.StructType([f for f in NET if f.name != DELETED])
INFO = struct(
    employee_id=S,
    **{c: at_offset(D if c in ("pay_rate", "pay_period_hours") else S) for c in INFO_COLUMNS},
    last_event_type=at_offset(S),
)
DOCUMENTS = struct(
    employee_id=S, first_name=S, last_name=S, email=S, pay_type=S, pay_rate=D, pay_period_hours=D, is_active=B,
    hire_date=S, pay_periods=T.ArrayType(PAY_PERIOD_RECORD), **{DELETED: B},
)
RECORDS = struct(
    employee_id=S,
    fields=at_offset(
        struct(first_name=S, last_name=S, email=S, pay_type=S, pay_rate=MONEY, pay_period_hours=MONEY)
    ),
    last=struct(off=L, event_type=S, occurred_on=TS, event_id=S, is_active=B),
    first=struct(off=L, occurred_on=TS),
    last_deactivated_off=L,
)
FEED = struct(off=L, employee_id=S, change_type=S)
