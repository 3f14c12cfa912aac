"""Pay notices as a stream-stream join: a pay row passes if its employee's record exists, whichever arrives first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def pay_notices(pay: DataFrame, records: DataFrame, earlier: str, later: str, delay: str = "0 seconds", salts: int = SALTS) -> DataFrame:
    """Rows of ``pay`` (employee_id, at, off ...) for which ``records`` (employee_id, at) has a row of the same employee
    between ``earlier`` before and ``later`` after; both may be streams.

    A left-semi join: each pay row passes at most once. The bounds on event time tell Spark how long a row can still find
    a partner, so that state is dropped behind the watermark (``delay`` behind the newest time of the slower stream);
    rows without a partner are dropped with it. Pay rows of an employee are spread over ``salts`` state partitions by
    their offset, and records are repeated for each.
    """
    left = pay.withWatermark("at", delay).withColumn("_salt", F.pmod(F.xxhash64("off"), F.lit(salts)))
    right = (
        records.select(F.col("employee_id").alias("_employee"), F.col("at").alias("_known"))
        .withWatermark("_known", delay)
        .withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    )
    near = F.expr(f"_known >= at - INTERVAL {earlier} AND _known <= at + INTERVAL {later}")
    met = (F.col("employee_id") == F.col("_employee")) & (F.col("_salt") == F.col("_slot")) & near
    return left.join(right, met, "left_semi").drop("_salt")
