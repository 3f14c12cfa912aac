"""Search documents: one row per employee with its newest pay periods nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright.functions.scalars import unless_false
from paywright.schemas import PAY_PERIOD_RECORD

# Fixed value: periods kept in a document.
MAX_PAY_PERIODS = 4


def last_pay_periods(net_pay: DataFrame, n: int = MAX_PAY_PERIODS) -> DataFrame:
    """The ``n`` highest live periods of each employee. The input is an aggregate with one row per period."""
    newest = Window.partitionBy("employee_id").orderBy(F.desc("pay_period_number"))
    live = net_pay.filter(F.col("pay_period_number") >= 0)
    return live.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def pay_period_arrays(net_pay: DataFrame, n: int = MAX_PAY_PERIODS) -> DataFrame:
    """(employee_id, pay_periods): at most ``n`` structs, ascending by period."""
    record = F.struct(*[_with_default(f) for f in PAY_PERIOD_RECORD])
    return (
        last_pay_periods(net_pay, n)
        .groupBy("employee_id")
        .agg(F.array_sort(F.collect_list(record)).alias("pay_periods"))
    )


def _with_default(field: T.StructField) -> Column:
    default = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(0).cast(field.dataType)
    return F.coalesce(F.col(field.name), default).alias(field.name)


def search_documents(info: DataFrame, net_pay: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Documents of active employees; employees without pay get an empty array, pay without employee is left out."""
    active = unless_false(F.col("is_active"))
    people = info if include_inactive else info.filter(active)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    none = F.array().cast(T.ArrayType(PAY_PERIOD_RECORD))
    return people.join(pay_period_arrays(net_pay).hint("merge"), "employee_id", "left").select(
        "employee_id", text("first_name"), text("last_name"), text("email"), text("pay_type"), number("pay_rate"),
        number("pay_period_hours"), active.alias("is_active"), text("hire_date"),
        F.coalesce("pay_periods", none).alias("pay_periods"),
    )


def camel_case(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part[:1].upper() + part[1:] for part in tail)


def search_hits(documents: DataFrame) -> DataFrame:
    """Documents as the client reads them: camelCase names at every level, integer pay type, never a NULL array."""
    schema = documents.schema["pay_periods"].dataType.elementType
    element = lambda p: F.struct(*[p[f.name].alias(camel_case(f.name)) for f in schema])
    renamed = F.transform("pay_periods", element)
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField(camel_case(f.name), f.dataType) for f in schema])))
    leading_digits = F.regexp_extract(F.col("pay_type"), r"^\s*([+-]?\d+)", 1)
    return documents.select(
        F.col("employee_id").alias("id"),
        F.col("first_name").alias("firstName"),
        F.col("last_name").alias("lastName"),
        "email",
        leading_digits.try_cast("int").alias("payType"),
        F.col("pay_rate").alias("payRate"),
        F.col("pay_period_hours").alias("payPeriodHours"),
        F.col("is_active").alias("isActive"),
        F.col("hire_date").alias("hireDate"),
        F.coalesce(renamed, none).alias("payPeriods"),
    )
