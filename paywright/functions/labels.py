"""Enum codes and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PAY_TYPES = {1: "Hourly", 2: "Salary"}
DEDUCTION_TYPES = {1: "Health", 2: "Dental", 3: "Vision", 4: "Retirement401k", 5: "LifeInsurance", 99: "Other"}


def label_of(code: Column, labels: dict[int, str]) -> Column:
    """Label of an integer code given as number or digits; NULL for an unknown one."""
    table = F.create_map(*[x for key, text in labels.items() for x in (F.lit(key), F.lit(text))])
    return F.try_element_at(table, code.try_cast("int"))


def pay_type_label(code: Column) -> Column:
    return label_of(code, PAY_TYPES)


def deduction_type_label(code: Column) -> Column:
    return label_of(code, DEDUCTION_TYPES)
