"""Withholding tax as column expressions, plus the same tables as small DataFrames for joins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywright.functions.scalars import round_cents

# 2024 brackets as (upper bound of yearly income, rate); the last bracket is open.
SINGLE_BRACKETS = [
    (11600.0, 0.10), (47150.0, 0.12), (100525.0, 0.22), (191950.0, 0.24),
    (243725.0, 0.32), (609350.0, 0.35), (None, 0.37),
]
MARRIED_BRACKETS = [
    (23200.0, 0.10), (94300.0, 0.12), (201050.0, 0.22), (383900.0, 0.24),
    (487450.0, 0.32), (731200.0, 0.35), (None, 0.37),
]
MARRIED_STATUSES = ["married", "marriedfilingjointly"]
PERIODS_PER_YEAR = 26

# Flat rate per state.
STATE_RATES = {
    "AL": 0.0500, "AK": 0.0, "AZ": 0.0250, "AR": 0.0440, "CA": 0.0930, "CO": 0.0440, "CT": 0.0500, "DE": 0.0660,
    "FL": 0.0, "GA": 0.0549, "HI": 0.0725, "ID": 0.0580, "IL": 0.0495, "IN": 0.0305, "IA": 0.0570, "KS": 0.0570,
    "KY": 0.0400, "LA": 0.0425, "ME": 0.0715, "MD": 0.0575, "MA": 0.0500, "MI": 0.0425, "MN": 0.0985, "MS": 0.0500,
    "MO": 0.0480, "MT": 0.0675, "NE": 0.0664, "NV": 0.0, "NH": 0.0, "NJ": 0.1075, "NM": 0.0590, "NY": 0.0685,
    "NC": 0.0450, "ND": 0.0195, "OH": 0.0350, "OK": 0.0475, "OR": 0.0990, "PA": 0.0307, "RI": 0.0599, "SC": 0.0640,
    "SD": 0.0, "TN": 0.0, "TX": 0.0, "UT": 0.0465, "VT": 0.0875, "VA": 0.0575, "WA": 0.0, "WV": 0.0512,
    "WI": 0.0530, "WY": 0.0, "DC": 0.0895,
}


def bracket_rows() -> list[tuple[str, float, float | None, float, float]]:
    """(schedule, lower, upper, rate, tax due on the brackets below) for both schedules."""
    rows = []
    for schedule, brackets in (("single", SINGLE_BRACKETS), ("married", MARRIED_BRACKETS)):
        lower = below = 0.0
        for upper, rate in brackets:
            rows.append((schedule, lower, upper, rate, below))
            if upper is not None:
                lower, below = upper, below + (upper - lower) * rate
    return rows


def schedule_of(filing_status: Column) -> Column:
    """'married' for the two joint statuses in any case; everything else, NULL included, is 'single'."""
    return F.when(F.lower(filing_status).isin(MARRIED_STATUSES), F.lit("married")).otherwise(F.lit("single"))


def _yearly_tax(income: str, schedule: str) -> str:
    """Sum over the brackets of the slice of ``income`` in each, as SQL text."""
    slices = [
        f"greatest(0.0D, {income if upper is None else f'least({income}, {upper}D)'} - {lower}D) * {rate}D"
        for name, lower, upper, rate, _ in bracket_rows()
        if name == schedule
    ]
    return " + ".join(slices)


def federal_tax(gross: str, filing_status: str) -> Column:
    """Progressive tax of one period from two columns: scale to a year, tax each bracket's slice, scale back."""
    income, years = f"({gross} * {PERIODS_PER_YEAR}.0D)", f"{PERIODS_PER_YEAR}.0D"
    married = F.expr(f"({_yearly_tax(income, 'married')}) / {years}")
    single = F.expr(f"({_yearly_tax(income, 'single')}) / {years}")
    return round_cents(F.when(schedule_of(F.col(filing_status)) == "married", married).otherwise(single))


def state_rate(state: Column) -> Column:
    """Rate of a state in any case; unknown, empty and NULL give 0."""
    table = F.from_json(F.lit(json.dumps(STATE_RATES)), "map<string,double>")  # a constant, folded while planning
    return F.coalesce(F.try_element_at(table, F.upper(state)), F.lit(0.0))


def state_tax_at(gross: Column, rate: Column) -> Column:
    """The yearly detour is kept because it decides the last bit before rounding."""
    return round_cents(gross * float(PERIODS_PER_YEAR) * rate / float(PERIODS_PER_YEAR))


def state_tax(gross: Column, state: Column) -> Column:
    return state_tax_at(gross, state_rate(state))


def bracket_table(spark: SparkSession) -> DataFrame:
    """Fourteen fixed rows: (schedule, lower_bound, upper_bound, rate, tax_below), the open upper bound as infinity."""
    rows = [(s, lo, float("inf") if up is None else up, r, below) for s, lo, up, r, below in bracket_rows()]
    return spark.createDataFrame(
        rows, "schedule string, lower_bound double, upper_bound double, rate double, tax_below double"
    )


def state_rate_table(spark: SparkSession) -> DataFrame:
    """Fifty-one fixed rows: (state_code, state_rate)."""
    return spark.createDataFrame(list(STATE_RATES.items()), "state_code string, state_rate double")


def with_federal_tax_by_lookup(df: DataFrame, gross: str, filing_status: str) -> DataFrame:
    """Adds ``federal_tax`` by a range join: each income meets the one bracket it ends in, without a shuffle.

    The bracket table has fourteen rows whatever the data, so broadcasting it is safe. No income, or none above zero,
    meets no bracket and owes nothing.
    """
    income = df.withColumns(
        {"_income": F.col(gross) * float(PERIODS_PER_YEAR), "_schedule": schedule_of(F.col(filing_status))}
    )
    brackets = F.broadcast(bracket_table(df.sparkSession))
    ends_in = (F.col("_schedule") == F.col("schedule")) & F.col("_income").between(F.col("lower_bound"), F.col("upper_bound"))
    due = F.col("tax_below") + (F.col("_income") - F.col("lower_bound")) * F.col("rate")
    return income.join(brackets, ends_in & (F.col("_income") > F.col("lower_bound")), "left").select(
        *df.columns, round_cents(F.coalesce(due, F.lit(0.0)) / float(PERIODS_PER_YEAR)).alias("federal_tax")
    )


def with_state_rate(df: DataFrame, state: str) -> DataFrame:
    """State rate by a left join to the fifty-one-row table."""
    rates = F.broadcast(state_rate_table(df.sparkSession))
    return (
        df.join(rates, F.upper(F.col(state)) == F.col("state_code"), "left")
        .withColumn("state_rate", F.coalesce("state_rate", F.lit(0.0)))
        .drop("state_code")
    )
