"""Lookups, listings and merges over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywright.functions.ordered import BLOCK_ROWS, Running, with_running


def get(table: DataFrame, **key) -> DataFrame:
    """Row of one (compound) key."""
    found = table
    for column, value in key.items():
        found = found.filter(F.col(column) == F.lit(value))
    return found


def get_many(table: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all requested keys; a key asked for twice is answered once."""
    return table.join(requests.select(*keys).distinct(), keys, "left_semi")


def entries_of(time_entries: DataFrame, employee_id: str | None = None) -> DataFrame:
    """Time entries, newest clock-in first, of one employee or of each."""
    if employee_id is not None:
        return get(time_entries, employee_id=employee_id).orderBy(F.desc("clock_in"), "id")
    return time_entries.orderBy("employee_id", F.desc("clock_in"), "id")


def open_entry(time_entries: DataFrame) -> DataFrame:
    """The entry each employee has open, the earliest if there are several."""
    rest = [c for c in time_entries.columns if c != "employee_id"]
    first = F.min_by(F.struct(*rest), F.struct("clock_in", "id")).alias("_row")
    return (
        time_entries.filter(F.col("clock_out").isNull())
        .groupBy("employee_id")
        .agg(first)
        .select("employee_id", "_row.*")
        .select(*time_entries.columns)
    )


def prefer(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of ``primary``, and those of ``fallback`` whose key it does not have."""
    values = [c for c in primary.columns if c != key]
    left = primary.select(key, F.struct(*values).alias("_first"))
    right = fallback.select(key, F.struct(*values).alias("_second"))
    return left.join(right, key, "full_outer").select(key, F.coalesce("_first", "_second").alias("_row")).select(
        key, "_row.*"
    )


def audit_history(info_events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All events of every employee with the pay rate known before each; order by (employee_id, off) to read it."""
    previous = {"previous_rate": Running("last", F.col("pay_rate"))}
    return with_running(
        info_events.filter(F.col("employee_id").isNotNull()), ["employee_id"], previous, block_rows=block_rows
    )


def merge_changes(current: DataFrame, incoming: DataFrame, key: str, null_is_absent: bool = True) -> DataFrame:
    """Incoming fields overwrite, fields they do not carry stay, unknown keys are added.

    ``incoming`` has one row per key and may lack columns. With ``null_is_absent`` a NULL counts as not carried.
    """
    changed = [c for c in incoming.columns if c != key]
    renamed = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed], F.lit(True).alias("_hit"))

    def merged(column: str) -> Column:
        if column not in changed:
            return F.col(column)
        new = F.col(f"_new_{column}")
        if null_is_absent:
            return F.coalesce(new, F.col(column)).alias(column)
        return F.when(F.col("_hit"), new).otherwise(F.col(column)).alias(column)

    return current.join(renamed, key, "full_outer").select(*[F.col(c) if c == key else merged(c) for c in current.columns])


def union_tagged(tag: str, **parts: DataFrame) -> DataFrame:
    """Rows of several logs with the same columns, each tagged with where it came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    whole = tagged[0]
    for part in tagged[1:]:
        whole = whole.unionByName(part)
    return whole
