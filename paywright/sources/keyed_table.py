"""A keyed table of hash buckets, each a Parquet folder, of which an upsert rewrites only those that hold a changed key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright.functions.aggregates import latest_rows

BUCKET = "bucket"
DELETED = "deleted"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema``, one per key, under ``path``; the row with the highest ``offset`` counts.

    A deleted key stays as a tombstone with the offset of its deletion. So the order in which changes arrive does not
    matter: a batch that is delivered again, or one that is older than what the table holds, leaves it as it is, and a
    bucket that was touched always has a row. ``buckets`` is fixed for the life of a table; choose it so that a bucket is
    some hundred MB.
    """

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int
    offset: str = "off"

    @property
    def _stored(self) -> T.StructType:
        more = [T.StructField(DELETED, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())]
        known = {f.name for f in self.schema}
        first = [] if self.offset in known else [T.StructField(self.offset, T.LongType())]
        return T.StructType([*self.schema.fields, *first, *more])

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, spark: SparkSession, changes: DataFrame, deleted: Column) -> list[int]:
        """Apply rows with the table's columns, ``offset`` and whatever ``deleted`` reads; returns the buckets rewritten.

        Changes are reduced to one row per key before anything is read. The list of touched buckets, at most ``buckets``
        numbers, prunes the scan of the table to their folders; the write replaces those folders and no others.
        """
        marked = changes.withColumn(DELETED, deleted).withColumn(BUCKET, self.bucket_of()).select(*self._stored.fieldNames())
        last = latest_rows(marked, list(self.keys), self.offset).persist()
        try:
            touched = sorted(r[0] for r in last.select(BUCKET).distinct().collect())
            if touched:
                merged = latest_rows(self.rows(spark, touched).unionByName(last), list(self.keys), self.offset)
                # One task for each bucket at most: a bucket's rows come to lie in few files.
                dealt = merged.repartition(F.col(BUCKET))
                dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        finally:
            last.unpersist()
        return touched

    def rows(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """Rows with tombstones, of some buckets or all; empty before anything is written."""
        try:
            stored = spark.read.schema(self._stored).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self._stored)
        return stored if buckets is None else stored.filter(F.col(BUCKET).isin(buckets))

    def read(self, spark: SparkSession) -> DataFrame:
        """The live rows."""
        return self.rows(spark).filter(~F.col(DELETED)).select(*self.schema.fieldNames())

    def lookup(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """The live rows of some keys; only the folders they hash to are read."""
        asked = keys.select(*self.keys).distinct().withColumn(BUCKET, self.bucket_of()).persist()
        try:
            touched = sorted(r[0] for r in asked.select(BUCKET).distinct().collect())
            found = self.rows(spark, touched).filter(~F.col(DELETED))
            return found.join(asked.drop(BUCKET), list(self.keys), "left_semi").select(*self.schema.fieldNames())
        finally:
            asked.unpersist()
