"""Joining points to the intervals that hold them, for any number of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8
#: The level of intervals without an end.
ENDLESS = 1 << 20


def _level(low: Column, high: Column) -> Column:
    """The least power of two that is at least an interval's width; cells of that size meet an interval at most twice."""
    width = (high - low).cast("double")
    return F.when(high.isNull() | (width == float("inf")), F.lit(ENDLESS)).otherwise(F.ceil(F.log2(width)).cast("int"))


def _cell(value: Column, level: Column) -> Column:
    return F.when(level == ENDLESS, F.lit(0).cast("bigint")).otherwise(F.floor(value / F.pow(F.lit(2.0), level.cast("double"))).cast("bigint"))


def join_intervals(
    points: DataFrame, intervals: DataFrame, keys: list[str], value: str, low: str, high: str, spread: str, salts: int = SALTS
) -> DataFrame:
    """Rows of ``points`` with each interval ``low <= value < high`` of the same ``keys``; an interval without ``high`` has no end.

    Intervals are cut at cells of their own order of magnitude, so each lies in at most two of them, and points look into
    the cell of every magnitude that occurs for their keys. Both meet by equality of keys, magnitude and cell; the exact
    bounds follow. So a wide interval costs no more rows than a narrow one, and nothing is compared with all intervals.

    The points of a cell are spread over ``salts`` tasks by a hash of ``spread``, and intervals are repeated for each: a
    value or key that a third of all points share does not land in one task. Points with a null value or key, and
    intervals that are empty or have a null ``low`` or key, find nothing.
    """
    v, a, b = F.col(value).cast("double"), F.col(low).cast("double"), F.col(high).cast("double")
    leveled = intervals.filter(a.isNotNull() & (b.isNull() | (b > a))).withColumn("_level", _level(a, b))
    first, last = _cell(a, F.col("_level")), _cell(b, F.col("_level"))
    cells = F.when(F.col("_level") == ENDLESS, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(first, last))
    cut = leveled.withColumn("_cell", F.explode(cells))
    repeated = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    # The magnitudes of a key are few (a double has some two thousand), whatever its number of intervals.
    levels = leveled.select(*keys, "_level").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    looking = salted.join(levels.hint("merge"), [*keys, "_salt"]).withColumn("_cell", _cell(v, F.col("_level")))
    met = looking.join(repeated.hint("merge"), [*keys, "_salt", "_level", "_cell"])
    return met.filter((v >= a) & (b.isNull() | (v < b))).drop("_salt", "_level", "_cell")
