"""Pay tables bucketed by employee, so that joins between them need no exchange."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paywright.operators import netpay
from paywright.plans.payroll import Payroll
from paywright.session import scratch_dir

KEY = "employee_id"


@dataclass(frozen=True)
class BucketedPayroll:
    """Gross pay, tax settings, deduction totals and deactivations, written once with the same buckets.

    All four are aggregates: an employee has one row in each, and one row per period in gross pay. A hot employee's log
    rows were combined before; what is left of them here, some dozens of periods a year of work, lies in one bucket
    without making it a large one. ``buckets`` is the parallelism of every later join.
    """

    gross: str
    tax: str
    deductions: str
    gone: str

    @classmethod
    def write(cls, payroll: Payroll, spark: SparkSession, buckets: int) -> BucketedPayroll:
        name = f"payroll_{uuid.uuid4().hex}"
        tables = {
            "gross": payroll.gross_pay(), "tax": payroll.tax_state(), "deductions": payroll.deduction_totals(),
            "gone": payroll.deactivated(),
        }
        for table, rows in tables.items():
            _write(rows, f"{name}_{table}", scratch_dir(spark, f"bucketed-{table}"), buckets)
        return cls(**{table: f"{name}_{table}" for table in tables})

    def net_pay(self, spark: SparkSession) -> DataFrame:
        """Net pay by merge joins of buckets: each bucket of a table meets the same bucket of the others where it lies."""
        gross, tax, deductions, gone = (spark.table(t).hint("merge") for t in (self.gross, self.tax, self.deductions, self.gone))
        return netpay.net_pay(gross, tax, deductions, gone)


def _write(rows: DataFrame, table: str, path: str, buckets: int) -> None:
    # Dealt as the buckets are, so that a bucket is one sorted file and joins need no sort either.
    dealt = rows.repartition(buckets, KEY)
    dealt.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).format("parquet").saveAsTable(table)
