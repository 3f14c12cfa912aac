"""Tables laid out for point lookups: clustered by their key, with bloom filters, in small row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 1 << 20


def write_clustered(rows: DataFrame, path: str, key: str, expected_keys: int, partitions: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``rows`` in ranges of ``key``, sorted within, with a bloom filter of the key in every row group.

    A reader that filters on keys opens few files by their footers, and in them skips the row groups whose bounds or
    bloom filter exclude the keys. A key that a third of all rows share fills as many row groups as its rows need: the
    whole row takes part in the range order as a hash. ``expected_keys`` sizes a filter: distinct keys of a row group.
    """
    others = [c for c in rows.columns if c != key]
    tie = F.xxhash64(*others) if others else F.lit(0)
    dealt = rows.withColumn("_tie", tie)
    dealt = dealt.repartitionByRange(partitions, key, "_tie") if partitions else dealt.repartitionByRange(key, "_tie")
    writer = dealt.sortWithinPartitions(key, "_tie").drop("_tie").write
    options = {
        f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(expected_keys),
        "parquet.block.size": str(row_group_bytes), "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100",
    }
    writer.options(**options).parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows of some keys, by a filter that reaches the row groups."""
    return spark.read.parquet(path).filter(F.col(key).isin(values) if len(values) != 1 else F.col(key) == values[0])
