"""Registered streaming queries: the log streams from the events table, the result is the table the job leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywright.driver import tables
from paywright.driver.queries import query
from paywright.schemas import EMPLOYEE_INFO
from paywright.session import scratch_dir
from paywright.sources.event_log import events_of
from paywright.streaming import jobs
from paywright.streaming.layouts import NET
from paywright.streaming.store import BatchStore


#: The log arrives in this many parts of equal offset range, one micro-batch each.
PARTS = 5


def _end(spark: SparkSession, sf: str) -> int:
    return (tables.table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0) + 1


def _part(spark: SparkSession, sf: str, part: int, end: int, *entities: str) -> DataFrame:
    """Rows of the events table in one part of the offset range; the kinds and the range reach the Parquet scan."""
    rows = tables.table(spark, sf, "events")
    if entities:
        rows = rows.filter(F.col("event_type").isin(tables.kinds_of(*entities)))
    low, high = -(-part * end // PARTS), -(-(part + 1) * end // PARTS)
    return rows.filter((F.col("event_id") >= low) & (F.col("event_id") < high))


def feed(spark: SparkSession, sf: str, entities: tuple[str, ...], start, shape=lambda log: log, to_log=tables.to_log) -> None:
    """Let the log arrive part by part: each part is written, then ``start(log, checkpoint)`` runs until it is consumed.

    The job starts over with the same checkpoint for every part, so each run continues from the state of the one before.
    """
    folder, checkpoint = scratch_dir(spark, "log"), scratch_dir(spark, "checkpoint")
    end = _end(spark, sf)
    for part in range(PARTS):
        _part(spark, sf, part, end, *entities).write.mode("append").parquet(folder)
        rows = spark.readStream.schema(tables.SCHEMAS["events"]).parquet(folder)
        start(shape(to_log(rows, *entities)), checkpoint).awaitTermination()


def _run(spark: SparkSession, sf: str, job, *entities: str, shape=lambda log: log) -> None:
    def body(raw: DataFrame, batch_id: int) -> None:
        job.process(raw.repartition("off"), batch_id)

    feed(spark, sf, entities, lambda log, checkpoint: jobs.run(log, body, checkpoint), shape)


@query
def stream_employee_info(spark, sf):
    store = BatchStore(scratch_dir(spark, "employee-info"))
    feed(spark, sf, ("employee",), lambda log, checkpoint: jobs.start_employee_info(events_of(log), store, checkpoint))
    return store.table(spark, EMPLOYEE_INFO, ["employee_id"]).drop("batch_id")


@query
def stream_hours(spark, sf):
    job = jobs.PayStream(spark, scratch_dir(spark, "hours"))
    _run(spark, sf, job, "timeentry")
    return job.hours_table()


@query
def stream_gross_pay(spark, sf):
    job = jobs.PayStream(spark, scratch_dir(spark, "gross"))
    _run(spark, sf, job, "timeentry", "employee")
    return job.gross_table().drop("last_off")


@query
def stream_replay(spark, sf):
    """Gross pay after the last part was processed a second time, as after a failure before its commit."""
    job = jobs.PayStream(spark, scratch_dir(spark, "replay"))
    entities = ("timeentry", "employee")
    _run(spark, sf, job, *entities)
    last = tables.spread(_part(spark, sf, PARTS - 1, _end(spark, sf), *entities))
    job.process(tables.to_log(last, *entities), PARTS - 1)
    return job.gross_table().drop("last_off")


@query
def stream_net_pay(spark, sf):
    job = jobs.NetPayStream(spark, scratch_dir(spark, "net-pay"), current_period=2)
    _run(spark, sf, job)
    return job.net_pay_table().drop("off")


@query
def stream_search(spark, sf):
    job = jobs.SearchStream(spark, scratch_dir(spark, "search"), current_period=2)
    _run(spark, sf, job)
    return job.document_table().select(
        "employee_id", "first_name", "email", F.size("pay_periods").cast("bigint").alias("periods"),
        F.round(F.aggregate("pay_periods", F.lit(0.0), lambda total, p: total + p["net_pay"]), 2).alias("net_pay_sum"),
    )


@query
def stream_projection(spark, sf):
    job = jobs.ProjectionStream(spark, scratch_dir(spark, "projection"))
    _run(spark, sf, job, "employee", shape=tables.redelivered)
    return job.record_table().select(
        "employee_id", "first_name", "is_active", "last_event_type", "last_event_id",
        F.unix_micros("last_event_timestamp").alias("last_event_us"),
    )


@query
def stream_change_feed(spark, sf):
    job = jobs.ProjectionStream(spark, scratch_dir(spark, "feed"))
    _run(spark, sf, job, "employee", shape=tables.redelivered)
    return job.change_feed()


@query
def stream_pay_updates(spark, sf):
    """Record and pay changes: the net-pay job's output streams into the read model behind the events."""
    net = jobs.NetPayStream(spark, scratch_dir(spark, "net-pay"), current_period=2)
    _run(spark, sf, net)
    model = jobs.ProjectionStream(spark, scratch_dir(spark, "projection"))
    _run(spark, sf, model, "employee")
    rows = spark.readStream.schema(NET).parquet(f"{net.net.path}/*")
    jobs.run(rows, model.process_pay, scratch_dir(spark, "checkpoint")).awaitTermination()
    return model.whole_feed()
