"""Explicit schemas: nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

# Names on the wire.
ENVELOPE_FIELDS = ["type", "source", "data"]

EMPLOYEE_EVENTS = ["employee.created", "employee.updated", "employee.deactivated", "employee.activated"]
TIME_ENTRY_EVENTS = ["timeentry.clockedin", "timeentry.clockedout", "timeentry.updated"]
TAX_EVENTS = ["taxinfo.created", "taxinfo.updated"]
DEDUCTION_EVENTS = ["deduction.created", "deduction.updated", "deduction.deactivated"]

NET_PAY_AMOUNTS = [
    "gross_pay", "federal_tax", "state_tax", "additional_federal_withholding", "additional_state_withholding",
    "total_tax", "total_fixed_deductions", "total_percent_deductions", "total_deductions", "net_pay",
]


RAW_LOG = T.StructType([T.StructField("off", T.LongType()), T.StructField("value", T.StringType())])

CHANGELOG = T.StructType(
    [
        T.StructField("off", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

NET_PAY_KEYS = ["employee_id", "pay_period_number"]

NET_PAY_VALUE = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in NET_PAY_AMOUNTS]
    + [
        T.StructField("pay_rate", T.DoubleType()),
        T.StructField("pay_type", T.StringType()),
        T.StructField("total_hours_worked", T.DoubleType()),
        T.StructField("pay_period_start", T.StringType()),
        T.StructField("pay_period_end", T.StringType()),
    ]
)

PAY_PERIOD_RECORD = T.StructType([T.StructField("pay_period_number", T.LongType()), *NET_PAY_VALUE.fields])

EMPLOYEE_INFO = T.StructType(
    [
        T.StructField("employee_id", T.StringType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("pay_type", T.StringType()),
        T.StructField("pay_rate", T.DoubleType()),
        T.StructField("pay_period_hours", T.DoubleType()),
        T.StructField("is_active", T.StringType()),
        T.StructField("hire_date", T.StringType()),
        T.StructField("last_event_type", T.StringType()),
    ]
)
