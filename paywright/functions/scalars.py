"""Lenient casts, rounding rules and text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(text: Column) -> Column:
    """Text to double; anything unparsable is NULL rather than an error."""
    return text.try_cast("double")


def as_long(text: Column) -> Column:
    return text.try_cast("bigint")


def as_flag(text: Column, default: bool) -> Column:
    """JSON boolean text; numbers count as true unless zero, everything else takes the default."""
    folded = F.lower(F.trim(text))
    number = folded.try_cast("double")
    return (
        F.when(folded == "true", F.lit(True))
        .when(folded == "false", F.lit(False))
        .when(number.isNotNull(), number != 0)
        .otherwise(F.lit(default))
    )


def unless_false(text: Column) -> Column:
    """Everything but the word 'false' (in any case) is true, a missing value included."""
    return F.lower(F.coalesce(text, F.lit("true"))) != "false"


def round_cents(value: Column) -> Column:
    """Half-up on doubles: floor(v * 100 + 0.5) / 100. ``round`` differs, e.g. for 1.005."""
    return F.floor(value * 100.0 + 0.5).cast("double") / 100.0


def round_half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value, digits)


def exact_sum(value: Column) -> Column:
    """Sum doubles independently of row order.

    Floating addition depends on the order in which partitions arrive, so a retried task could change a cent. Values go
    through a decimal; those too large for it (or NaN) are added as doubles.
    """
    exact = value.try_cast("decimal(28,10)")
    rest = F.sum(F.when(exact.isNull(), value))
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))


def event_prefix(event_type: Column) -> Column:
    return F.split_part(event_type, F.lit("."), F.lit(1))


def change_type(event_type: Column) -> Column:
    """'employee.created' -> 'created'; a name without a dot stays as it is."""
    return F.when(event_type.contains("."), F.split_part(event_type, F.lit("."), F.lit(2))).otherwise(event_type)


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, '^"|"$', "")


def map_last_wins(keys: Column, values: Column) -> Column:
    """Zip two arrays into a map where a repeated key keeps the last value.

    Built from the distinct keys, so it does not depend on ``spark.sql.mapKeyDedupPolicy``.
    """
    last_of = lambda k: F.element_at(
        F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda pair: pair["k"] == k), -1
    )["v"]
    distinct = F.array_distinct(keys)
    return F.map_from_arrays(distinct, F.transform(distinct, last_of))


def sum_array(values: Column, start: float = 0.0) -> Column:
    return F.aggregate(values, F.lit(start), lambda total, x: total + x)
