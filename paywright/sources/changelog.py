"""Keyed changelogs: rows as JSON key and value, a NULL value being a tombstone that deletes the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright.functions.aggregates import latest_rows
from paywright.functions.scalars import strip_quotes


def _key_json(keys: list[str]) -> Column:
    """One key column gives a JSON string, several give a JSON object."""
    if len(keys) == 1:
        listed = F.to_json(F.array(F.col(keys[0])))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)
    return F.to_json(F.struct(*[F.col(k).alias(k.upper()) for k in keys]))


def to_changelog(df: DataFrame, keys: list[str], deleted: Column | None = None, offset: str = "off") -> DataFrame:
    """Rows to (off, key, value) with upper-case member names; rows marked ``deleted`` become tombstones."""
    values = [c for c in df.columns if c not in keys and c != offset]
    value = F.to_json(F.struct(*[F.col(c).alias(c.upper()) for c in values]))
    if deleted is not None:
        value = F.when(~deleted, value)
    return df.select(F.col(offset).alias("off"), _key_json(keys).alias("key"), value.alias("value"))


def tombstones(keys_df: DataFrame, keys: list[str], offset: Column | None = None) -> DataFrame:
    """(off, key, NULL) for each distinct key."""
    off = F.lit(None).cast("bigint") if offset is None else offset
    distinct = keys_df.groupBy(*keys).agg(F.max(off).alias("off"))
    return distinct.select("off", _key_json(keys).alias("key"), F.lit(None).cast("string").alias("value"))


def write_changelog(changes: DataFrame, path: str, mode: str = "append") -> None:
    changes.write.mode(mode).parquet(path)


def table_from_changelog(changes: DataFrame, keys: list[str], offset: str = "off") -> DataFrame:
    """Last record per key without the keys whose last record is a tombstone. ``changes`` has a ``value`` column."""
    return latest_rows(changes, keys, offset).filter(F.col("value").isNotNull())


def parse_changelog(table: DataFrame, key_fields: T.StructType, value_fields: T.StructType) -> DataFrame:
    """(off, key, value) with JSON texts to typed columns."""
    upper = lambda s: T.StructType([T.StructField(f.name.upper(), f.dataType) for f in s])
    names = lambda s: [(f.name.upper(), f.name) for f in s]
    if len(key_fields) == 1:
        only = key_fields[0]
        keys = [employee_of_key(F.col("key")).cast(only.dataType).alias(only.name)]
    else:
        parsed = F.from_json("key", upper(key_fields))
        keys = [parsed[wire].alias(name) for wire, name in names(key_fields)]
    value = F.from_json("value", upper(value_fields))
    return table.select("off", *keys, *[value[wire].alias(name) for wire, name in names(value_fields)])


def employee_of_key(key: Column) -> Column:
    """Employee id of a record key: a JSON string, a JSON object with EMPLOYEE_ID, or the bare id."""
    return F.when(F.ltrim(key).startswith("{"), F.get_json_object(key, "$.EMPLOYEE_ID")).otherwise(
        F.coalesce(
            F.get(F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<string>"), F.lit(0)), strip_quotes(key)
        )
    )


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], deleted: Column, offset: str = "off") -> DataFrame:
    """Target rows not touched by ``changes``, plus the last change of each key unless it deletes.

    ``changes`` has the target's columns, ``offset``, and whatever ``deleted`` reads. They are reduced to one row per key
    before anything is joined.
    """
    last = latest_rows(changes, keys, offset)
    kept = target.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter(~deleted).select(*target.columns))
