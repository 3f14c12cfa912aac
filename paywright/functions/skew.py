"""Joining raw event rows to a table that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16

_SALT = "_salt"


def join_one_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    how: str = "left",
    spread: str = "off",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` (any number per key) to ``per_key`` (at most one per key).

    The rows of a key are spread over ``salts`` partitions by a hash of ``spread``; the single-row side is repeated once
    per salt. AQE can split skewed partitions too, but not where a later grouping relies on the join's partitioning.
    The salt is a hash, not a random number, so a recomputed task puts each row where it was before.

    The join is a sort-merge join. Spark's estimate of the repeated side neither counts the repetition nor what
    decoding Parquet adds, so that a broadcast of it could take as many times the driver's memory; and rows that are
    broadcast to need no salt.
    """
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(spread), F.lit(salts)))
    repeated = per_key.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(repeated.hint("merge"), [*keys, _SALT], how).drop(_SALT)
