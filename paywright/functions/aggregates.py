"""Latest-value aggregates. All of them combine on the map side, so a hot key is reduced before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(value: Column, offset: Column) -> Column:
    """Value of the row with the highest offset, NULL included."""
    return F.max_by(value, offset)


def latest_present(value: Column, offset: Column) -> Column:
    """Latest value that is not NULL: rows without a value take no part in the ordering."""
    return F.max_by(value, F.when(value.isNotNull(), offset))


def latest_rows(df: DataFrame, keys: list[str], offset: str = "off") -> DataFrame:
    """One whole row per key, the one with the highest offset."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.col(offset)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)
