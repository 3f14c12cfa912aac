"""Streaming payroll: log -> hours and gross pay -> net pay -> search documents, and the idempotent read model.

Each job is a ``foreachBatch`` body made of the batch operators. A micro-batch is first reduced to partial aggregates (on
the map side, so a hot employee is cheap), then only the keys it touched are recomputed. Time entries are kept as partials
per batch, which merge in any order; settings and records as snapshots of one row per key. There is no watermark: late
events always count.

State is read back from Parquet, which Spark estimates by its compressed size. Joins with what grows with the employees
therefore ask for a merge, so that no table of theirs is broadcast through the driver.

A per-employee state machine (``transformWithState`` keyed by employee) would send every row of a hot employee through
one task, so it is not used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paywright.functions.aggregates import latest_rows
from paywright.functions.skew import join_one_per_key
from paywright.operators import extract, netpay, pay, people, projection
from paywright.plans.search_documents import last_pay_periods, search_documents
from paywright.schemas import NET_PAY_KEYS
from paywright.sources.changelog import to_changelog
from paywright.sources.event_log import events_of
from paywright.sources.published import Published
from paywright.streaming.layouts import (
    DEDUCTIONS, DOCUMENTS, FEED, GONE, GROSS, INFO, NET, PARTIALS, PAY, PAY_ROWS, RECORDS, SETTINGS, TAX,
)
from paywright.streaming.store import BATCH, DELETED, BatchStore, Snapshot, TieredStore, union_all


def run(
    source: DataFrame,
    body: Callable[[DataFrame, int], None],
    checkpoint: str,
    continuous: str | None = None,
) -> StreamingQuery:
    """Start a job: everything available now, or forever at the given interval.

    With the same checkpoint folder a restarted job goes on where it stopped and repeats at most its last batch.
    """
    writer = source.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


class PayStream:
    """Hours and gross pay per employee and period, kept current with edits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.partials = TieredStore(f"{folder}/partials", PARTIALS, pay.merge_partials, ("pay_period_number",))
        #: Gross pay and hours of the periods each batch touched; read as ``GROSS`` it is gross pay alone.
        self.gross = BatchStore(f"{folder}/pay", ("pay_period_number",))

    def process(self, raw: DataFrame, batch_id: int) -> None:
        self.process_events(events_of(raw), batch_id)

    def process_events(self, events: DataFrame, batch_id: int) -> None:
        self.partials.write(pay.entry_partials(extract.gross_pay_events(events)), batch_id)
        self.gross.write(self._touched_gross(batch_id).select(*PAY.fieldNames()), batch_id)

    def _touched_gross(self, batch_id: int) -> DataFrame:
        """Gross pay, out of the partials of all batches, for the (employee, period) pairs of this one.

        Partials are partitioned by period, and a batch usually touches the current one or two: the touched numbers prune
        the partitions. A timestamp lies in one of 261,000 periods (years 1 to 9999), so they are at most 2 MB to broadcast.
        The pairs are compared with the sums, which lie by pair already, rather than with the partials: those move once,
        by entry, to be merged, and never by employee.
        """
        touched = self.partials.batch(self.spark, batch_id).select(*pay.PERIOD_KEYS).distinct()
        numbers = F.broadcast(touched.select("pay_period_number").distinct())
        pruned = self.partials.read(self.spark, batch_id).join(numbers, "pay_period_number", "left_semi")
        gross = pay.gross_from_partials(pay.merge_partials(pruned), with_hours=True)
        return gross.join(touched.hint("merge"), pay.PERIOD_KEYS, "left_semi")

    def hours_table(self) -> DataFrame:
        newest = self.gross.table(self.spark, PAY, pay.PERIOD_KEYS).filter(F.col("entry_events") > 0)
        return newest.select(
            *pay.PERIOD_KEYS, F.col("entry_hours").alias("total_hours_worked"), F.col("entry_events").alias("event_count"),
            "pay_period_start", "pay_period_end",
        )

    def gross_table(self) -> DataFrame:
        return self.gross.table(self.spark, GROSS, pay.PERIOD_KEYS).drop(BATCH)


def _of_kind(settings: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    return settings.filter(F.col("kind") == kind).select(*schema.fieldNames())


class NetPayStream:
    """Net pay from the log: recomputed where gross pay changed, and in the current period where settings changed.

    Offsets follow arrival, so a row computed in this batch sees the settings left by the batches before (a snapshot) and
    those of this batch up to its own offset. Deactivated employees get tombstones for every period they had, now and for
    whatever arrives later.
    """

    def __init__(self, spark: SparkSession, folder: str, current_period: int | None = None):
        self.spark = spark
        self.current_period = current_period
        self.pay = PayStream(spark, folder)
        self.settings = Snapshot(f"{folder}/settings", SETTINGS)
        self.net = BatchStore(f"{folder}/net_pay")

    def process(self, raw: DataFrame, batch_id: int) -> None:
        events = events_of(raw).persist()
        try:
            self.process_events(events, batch_id)
        finally:
            events.unpersist()

    def process_events(self, events: DataFrame, batch_id: int) -> None:
        spark = self.spark
        self.pay.process_events(events, batch_id)
        new_tax, new_deductions = extract.tax_events(events), extract.deduction_events(events)
        before = self.settings.before(spark, batch_id)
        tax = _of_kind(before, "tax", TAX).unionByName(new_tax)
        deductions = _of_kind(before, "deduction", DEDUCTIONS).unionByName(new_deductions.drop("event_type"))
        newly_gone = people.deactivated_employees(events)
        kinds = {
            "tax": latest_rows(tax, ["employee_id"]), "deduction": people.deduction_state(deductions, with_offset=True),
            "gone": _of_kind(before, "gone", GONE).union(newly_gone).distinct(),
        }
        self.settings.write(union_all([rows.withColumn("kind", F.lit(kind)) for kind, rows in kinds.items()]), batch_id)

        gone = _of_kind(self.settings.after(spark, batch_id), "gone", GONE)
        due = self._due(new_tax, new_deductions, batch_id).persist()
        employees = due.select("employee_id").distinct()
        of_due = lambda rows: join_one_per_key(rows, employees, ["employee_id"], "left_semi")
        live = netpay.net_pay_asof(due, of_due(tax), of_due(deductions), self.current_period, gone)
        rows = live.withColumn("off", F.col("emitted_off")).withColumn(DELETED, F.lit(False)).select(*NET.fieldNames())

        dead = due.select(*NET_PAY_KEYS).join(gone.hint("merge"), "employee_id", "left_semi")
        if not newly_gone.isEmpty():  # only then does the history of gross pay matter
            known = self.pay.gross.read(spark, GROSS, batch_id).select(*NET_PAY_KEYS)
            dead = dead.union(known.join(newly_gone.hint("merge"), "employee_id", "left_semi"))
        dead = dead.distinct().withColumn(DELETED, F.lit(True))
        self.net.write(rows.unionByName(dead, allowMissingColumns=True).select(*NET.fieldNames()), batch_id)
        due.unpersist()

    def _due(self, new_tax: DataFrame, new_deductions: DataFrame, batch_id: int) -> DataFrame:
        """Gross rows to compute: those this batch changed, and the current period of employees with new settings."""
        here = F.col(BATCH) == batch_id
        gross = self.pay.gross.read(self.spark, GROSS, batch_id)
        due = gross.filter(here)
        if self.current_period is not None:
            changed = new_tax.select("employee_id").union(new_deductions.select("employee_id")).distinct()
            current = gross.filter(F.col("pay_period_number") == self.current_period)
            same = latest_rows(current, pay.PERIOD_KEYS, BATCH).filter(~here)
            due = due.unionByName(same.join(changed.hint("merge"), "employee_id", "left_semi"))
        return due.drop(BATCH)

    def net_pay_table(self) -> DataFrame:
        return self.net.table(self.spark, NET, NET_PAY_KEYS).drop(BATCH)

    def changelog(self) -> DataFrame:
        """The net-pay topic: (off, key, value) of every emitted row, tombstones included; ``off`` counts batches."""
        rows = self.net.read(self.spark, NET).withColumn("off", F.col(BATCH))
        return to_changelog(rows.drop(BATCH), NET_PAY_KEYS, deleted=F.col(DELETED))


class SearchStream:
    """Search documents, rebuilt for every employee whose fields or pay changed; inactive ones are deleted.

    The state is one row per employee plus its newest periods. Only deactivation deletes net-pay rows, and it deletes all
    of an employee's, so older periods are never needed again.
    """

    def __init__(self, spark: SparkSession, folder: str, current_period: int | None = None):
        self.spark = spark
        self.net = NetPayStream(spark, folder, current_period)
        self.info = Snapshot(f"{folder}/employee_info", INFO)
        self.periods = Snapshot(f"{folder}/last_periods", NET)
        self.documents = BatchStore(f"{folder}/documents")

    def process(self, raw: DataFrame, batch_id: int) -> None:
        spark = self.spark
        events = events_of(raw).persist()
        try:
            self.net.process_events(events, batch_id)
            new_info = people.info_partials(extract.employee_info_events(events)).persist()
            merged = people.merge_info_partials(self.info.before(spark, batch_id).unionByName(new_info))
            self.info.write(merged, batch_id)
            touched = new_info.select("employee_id")
            self._write_documents(touched, batch_id)
            new_info.unpersist()
        finally:
            events.unpersist()

    def _write_documents(self, with_new_fields: DataFrame, batch_id: int) -> None:
        spark = self.spark
        new_pay = self.net.net.read(spark, NET, batch_id).filter(F.col(BATCH) == batch_id)
        old_pay = self.periods.before(spark, batch_id).withColumn(BATCH, F.lit(-1).cast("bigint"))
        newest = latest_rows(old_pay.unionByName(new_pay), NET_PAY_KEYS, BATCH).filter(~F.col(DELETED))
        self.periods.write(last_pay_periods(newest), batch_id)

        touched = with_new_fields.union(new_pay.select("employee_id")).distinct().hint("merge")
        info = people.info_from_partials(self.info.after(spark, batch_id).join(touched, "employee_id", "left_semi"))
        periods = self.periods.after(spark, batch_id).join(touched, "employee_id", "left_semi")
        built = search_documents(info, periods, include_inactive=True).withColumn(DELETED, ~F.col("is_active"))
        self.documents.write(built.select(*DOCUMENTS.fieldNames()), batch_id)

    def document_table(self) -> DataFrame:
        return self.documents.table(self.spark, DOCUMENTS, ["employee_id"]).drop(BATCH)


class ProjectionStream:
    """Idempotent employee records, their pay rows and the change feed.

    A batch of events is judged against the newest timestamp accepted in earlier batches, so a replayed or re-delivered
    log changes nothing. Pay rows come from a second stream (``process_pay``) whose offsets belong to the same log; let it
    run behind the events, since a pay row counts only once its employee is known.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.state = Snapshot(f"{folder}/records", RECORDS)
        self.records = BatchStore(f"{folder}/record_changes")
        self.feed = BatchStore(f"{folder}/change_feed")
        self.shown = Snapshot(f"{folder}/last_counted", PAY_ROWS)
        self.pay_rows = BatchStore(f"{folder}/pay_changes")

    def process(self, raw: DataFrame, batch_id: int) -> None:
        before = self.state.before(self.spark, batch_id)
        changes = projection.employee_changes(events_of(raw))
        accepted = projection.accepted_events(changes, projection.record_from_partials(before)).persist()
        try:
            new = projection.record_partials(accepted)
            self.state.write(projection.merge_record_partials(before.unionByName(new)), batch_id)
            merged = self.state.after(self.spark, batch_id)
            self.records.write(merged.join(new.select("employee_id").hint("merge"), "employee_id", "left_semi"), batch_id)
            self.feed.write(projection.change_feed(accepted), batch_id)
        finally:
            accepted.unpersist()

    def process_pay(self, net_pay: DataFrame, batch_id: int) -> None:
        """One batch of net-pay rows (the columns of ``NET``); deleted ones say nothing here.

        The last row that counted stands for all before it: those that count never go back in period, except across a
        deactivation, and deactivations are in the feed. A batch that is delivered again adds nothing: rows that are not
        later than the employee's last counted one have been judged before.
        """
        spark = self.spark
        rows = projection.valid_pay_rows(net_pay.filter(~F.col(DELETED)).select(*PAY_ROWS.fieldNames()))
        before = self.shown.before(spark, batch_id)
        done = before.select("employee_id", F.col("off").alias("_done"))
        fresh = join_one_per_key(rows.dropDuplicates(["employee_id", "pay_period_number", "off"]), done, ["employee_id"])
        rows = fresh.filter(F.col("_done").isNull() | (F.col("off") > F.col("_done"))).select(*PAY_ROWS.fieldNames())
        known = before.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
        created = self._record_rows().select(
            "employee_id", F.col("first.off").alias("off"), F.lit("employee.created").alias("event_type")
        )
        ended = self.change_feed().filter(F.col("change_type") == "deactivated").select(
            "employee_id", "off", F.lit("employee.deactivated").alias("event_type")
        )
        counted = projection.pay_changes(known, created.union(ended)).persist()
        try:
            self.shown.write(latest_rows(counted.drop("_new"), ["employee_id"]), batch_id)
            self.pay_rows.write(counted.filter("_new").drop("_new"), batch_id)
        finally:
            counted.unpersist()

    def _record_rows(self) -> DataFrame:
        return self.records.table(self.spark, RECORDS, ["employee_id"]).drop(BATCH)

    def record_table(self) -> DataFrame:
        return projection.record_from_partials(self._record_rows())

    def pay_table(self) -> DataFrame:
        """The pay row each employee shows now; deactivations seen since are taken into account."""
        return projection.pay_attributes(self.pay_rows.read(self.spark, PAY_ROWS).drop(BATCH), self.record_table())

    def change_feed(self) -> DataFrame:
        return self.feed.read(self.spark, FEED).drop(BATCH)

    def whole_feed(self) -> DataFrame:
        """Changes of records and of pay."""
        paid = self.pay_rows.read(self.spark, PAY_ROWS).select("off", "employee_id", F.lit("payUpdated").alias("change_type"))
        return self.change_feed().unionByName(paid)


def start_employee_info(events: DataFrame, store: BatchStore, checkpoint: str) -> StreamingQuery:
    """The employee table as a native streaming aggregation: every batch emits the rows of the employees it touched."""
    table = people.employee_info(extract.employee_info_events(events))
    writer = table.writeStream.outputMode("update").foreachBatch(lambda rows, batch_id: store.write(rows, batch_id))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild(log: DataFrame, project: Callable[[DataFrame], DataFrame], path: str) -> int:
    """Build a projection again from the whole log and publish it in place of the old one; returns how many rows that had.

    The old version stays readable until the new one is complete, also if building it fails half-way.
    """
    table = Published(path)
    old = table.read(log.sparkSession)
    dropped = 0 if old is None else old.count()
    table.publish(project(log))
    return dropped
