"""What streaming jobs keep on a shared file system, as plain Parquet folders.

``BatchStore`` appends one folder per micro-batch: a changelog. ``Snapshot`` holds a whole (small) state, written anew by
each batch. Either way a batch writes its folder whole, so a replayed batch replaces what its first attempt left behind,
and it reads only what earlier batches wrote. A job that starts over with a new checkpoint needs new folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright.functions.aggregates import latest_rows

BATCH = "batch_id"
DELETED = "deleted"


@dataclass(frozen=True)
class BatchStore:
    path: str
    partition_by: tuple[str, ...] = ()

    def write(self, rows: DataFrame, batch_id: int) -> None:
        # Static: a replayed batch must also drop partitions that only its first attempt wrote.
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/{BATCH}={batch_id}")

    def read(self, spark: SparkSession, schema: T.StructType, upto: int | None = None) -> DataFrame:
        """All rows with their ``batch_id``; empty before anything is written."""
        whole = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        try:
            rows = spark.read.schema(whole).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], whole)
        return rows if upto is None else rows.filter(F.col(BATCH) <= upto)

    def table(self, spark: SparkSession, schema: T.StructType, keys: list[str], upto: int | None = None) -> DataFrame:
        """Latest row per key over all batches, without deleted keys."""
        newest = latest_rows(self.read(spark, schema, upto), keys, BATCH)
        return newest.filter(~F.col(DELETED)).drop(DELETED) if DELETED in newest.columns else newest


def compact(spark: SparkSession, old: BatchStore, new: BatchStore, schema: T.StructType, keys: list[str], upto: int) -> None:
    """Write the table of ``old`` as the single batch ``upto`` of another store; restart the job on that one."""
    kept = latest_rows(old.read(spark, schema, upto), keys, BATCH).drop(BATCH)
    new.write(kept, upto)


@dataclass(frozen=True)
class TieredStore:
    """Partial aggregates of micro-batches, merged as they grow old, so that a reader opens few folders.

    Batch ``b`` writes block ``b`` of level 0. Whenever ``fan`` blocks of a level are complete, the batch that completed
    them merges them into one block of the next level. Which blocks make up all batches so far follows from the batch
    number alone; there are at most ``fan - 1`` of each level, and every row is rewritten once a level. Folders are whole,
    so a replayed batch writes the same blocks again. Batch numbers begin at 0.
    """

    path: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    partition_by: tuple[str, ...] = ()
    fan: int = 4

    def _folder(self, level: int, block: int) -> str:
        return f"{self.path}/level-{level}/block-{block}"

    def _blocks(self, upto: int) -> list[tuple[int, int]]:
        """The largest blocks that together hold the batches 0 to ``upto``."""
        found, done, total = [], 0, upto + 1
        level = 0
        while self.fan ** (level + 1) <= total:
            level += 1
        while level >= 0:
            size = self.fan**level
            while done + size <= total:
                found.append((level, done // size))
                done += size
            level -= 1
        return found

    def _write(self, rows: DataFrame, level: int, block: int) -> None:
        writer = rows.select(*self.schema.fieldNames()).write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy(*self.partition_by).parquet(self._folder(level, block))

    def _read(self, spark: SparkSession, blocks: list[tuple[int, int]]) -> DataFrame:
        return union_all([spark.read.schema(self.schema).parquet(self._folder(*block)) for block in blocks])

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._write(rows, 0, batch_id)
        level, spark = 1, rows.sparkSession
        while (batch_id + 1) % self.fan**level == 0:
            block = (batch_id + 1) // self.fan**level - 1
            parts = [(level - 1, block * self.fan + i) for i in range(self.fan)]
            self._write(self.merge(self._read(spark, parts)), level, block)
            level += 1

    def batch(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What one batch wrote."""
        return self._read(spark, [(0, batch_id)])

    def read(self, spark: SparkSession, upto: int) -> DataFrame:
        """Partials of all batches up to one; those of a key may lie in several rows."""
        return self._read(spark, self._blocks(upto))


@dataclass(frozen=True)
class Snapshot:
    """State after a batch, in two alternating folders: a batch reads one and writes the other.

    For state that grows with the number of employees, not with the log, so that writing it whole stays cheap and no
    batch has to read the history.
    """

    path: str
    schema: T.StructType

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._slot(batch_id))

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """State left by the batch before; empty for the first one."""
        return spark.createDataFrame([], self.schema) if batch_id == 0 else self.after(spark, batch_id - 1)

    def after(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self._slot(batch_id))

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/slot={batch_id % 2}"


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are NULL there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
