"""Net pay by keyed state: one state per employee, fed with rows that were reduced before they reach it.

The job has two halves, each with its own checkpoint. ``SignalStream`` is a ``foreachBatch`` body: it keeps gross pay and
writes, for each batch, what an employee's state has to know. ``start_states`` streams those signals into
``transformWithState``. Raw rows of a hot employee are thus combined on the map side of the first half; the task that owns
the employee's state gets one row for each period, setting and deduction of a batch (for each slot between two gross rows,
where settings change in between).

Spark offers no other operator with several state variables per key, so the second half runs Python workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from paywright.functions.aggregates import latest, latest_present
from paywright.functions.skew import join_one_per_key
from paywright.operators import extract, netpay, people
from paywright.sources.event_log import events_of
from paywright.streaming.jobs import PayStream
from paywright.streaming.layouts import GROSS, NET, B, D, L, S, struct
from paywright.streaming.store import BATCH, DELETED, BatchStore, union_all

TAX_TERMS = struct(
    federal_filing_status=S, state=S, additional_federal_withholding=D, additional_state_withholding=D
)
DEDUCTION_TERMS = struct(deduction_id=S, amount=D, is_percentage=B, is_active=B)
GROSS_TERMS = T.StructType([f for f in GROSS if f.name != "employee_id"])
#: One member is set: a gross row, tax settings, a deduction, or ``gone``.
SIGNALS = struct(employee_id=S, off=L, gross=GROSS_TERMS, tax=TAX_TERMS, deduction=DEDUCTION_TERMS, gone=B)
CONFIGURED = T.StructType(
    [*GROSS.fields, *TAX_TERMS.fields, *struct(fixed_total=D, percent_share=D, emitted_off=L, **{DELETED: B}).fields]
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SignalStream:
    """First half: a batch of the log becomes signals, at most one for each key and slot of an employee."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.pay = PayStream(spark, folder)
        self.signals = BatchStore(f"{folder}/signals")

    def process(self, raw: DataFrame, batch_id: int) -> None:
        events = events_of(raw).persist()
        try:
            self.pay.process_events(events, batch_id)
            gross = self.pay.gross.read(self.spark, GROSS, batch_id).filter(F.col(BATCH) == batch_id).select(*GROSS.fieldNames())
            self.signals.write(signals(events, gross), batch_id)
        finally:
            events.unpersist()


def signals(events: DataFrame, gross: DataFrame) -> DataFrame:
    """Signals of a batch, given the gross rows it changed.

    Settings are reduced per slot: the last offsets of an employee's changed gross rows cut the batch, and what happens
    between two of them can only be seen together.
    """
    bounds = gross.groupBy("employee_id").agg(F.array_sort(F.collect_list("last_off")).alias("_bounds"))
    off = F.col("off")

    def slotted(rows: DataFrame) -> DataFrame:
        placed = join_one_per_key(rows, bounds, ["employee_id"], "left")
        slot = F.size(F.filter("_bounds", lambda bound: bound < off))
        return placed.withColumn("_slot", F.when(F.col("_bounds").isNull(), 0).otherwise(slot)).drop("_bounds")

    tax = slotted(extract.tax_events(events)).groupBy("employee_id", "_slot").agg(
        F.max_by(F.struct(*TAX_TERMS.fieldNames()), "off").alias("tax"), F.max("off").alias("off")
    )
    deductions = slotted(extract.deduction_events(events)).groupBy("employee_id", "_slot", "deduction_id").agg(
        latest_present(F.col("amount"), off).alias("amount"),
        latest_present(F.col("is_percentage"), off).alias("is_percentage"),
        latest(F.col("is_active"), off).alias("is_active"),
        F.max("off").alias("off"),
    )
    gone = people.deactivated_employees(events)
    parts = [
        gross.select("employee_id", F.col("last_off").alias("off"), F.struct(*GROSS_TERMS.fieldNames()).alias("gross")),
        tax.select("employee_id", "off", "tax"),
        deductions.select("employee_id", "off", F.struct(*DEDUCTION_TERMS.fieldNames()).alias("deduction")),
        gone.select("employee_id", F.lit(-1).cast("bigint").alias("off"), F.lit(True).alias("gone")),
    ]
    return union_all(parts).select(*SIGNALS.fieldNames())


def _processor(current_period: int | None) -> StatefulProcessor:
    # Defined here so that it travels by value: workers need not have this package.
    tax_schema, deduction_schema, gross_schema = TAX_TERMS, DEDUCTION_TERMS, GROSS_TERMS
    terms = T.StructType([f for f in deduction_schema if f.name != "deduction_id"])
    id_schema, period_schema, flag_schema = struct(deduction_id=S), struct(pay_period_number=L), struct(gone=B)
    columns = CONFIGURED.fieldNames()
    cent_of_cents = Decimal("1e-10")

    class EmployeePay(StatefulProcessor):
        """Latest settings and gross rows of an employee; emits every row that a batch gives reason to compute."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.tax = handle.getValueState("tax", tax_schema)
            self.deductions = handle.getMapState("deductions", id_schema, terms)
            self.gross = handle.getMapState("gross", period_schema, gross_schema)
            self.gone = handle.getValueState("gone", flag_schema)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            employee = key[0]
            batch = sorted(rows, key=lambda r: r["off"])  # a row for each key and slot, not for each event
            known = [k[0] for k in self.gross.keys()] if any(r["gone"] for r in batch) else []
            if known or any(r["gone"] for r in batch):
                self.gone.update((True,))
            gone = self.gone.exists()
            tax = self.tax.get() if self.tax.exists() else None
            deductions = {k[0]: tuple(v) for k, v in self.deductions.iterator()}
            emitted: dict[int, dict] = {}
            new_tax, new_deductions = None, {}  # every write is a call out of the worker, so only what changed is written
            moved = -1
            for r in batch:
                if r["tax"] is not None:
                    tax = new_tax = tuple(r["tax"][c] for c in tax_schema.fieldNames())
                    moved = r["off"]
                elif r["deduction"] is not None:
                    name, amount, percent, active = (r["deduction"][c] for c in deduction_schema.fieldNames())
                    old = deductions.get(name, (0.0, False, False))
                    now = (old[0] if amount is None else amount, old[1] if percent is None else percent, active)
                    deductions[name] = new_deductions[name] = now
                    moved = r["off"]
                elif r["gross"] is not None:
                    row = r["gross"]
                    self.gross.updateValue((row["pay_period_number"],), tuple(row[c] for c in gross_schema.fieldNames()))
                    emitted[row["pay_period_number"]] = {**row, **self._settings(tax, deductions), "emitted_off": row["last_off"]}
            if new_tax is not None:
                self.tax.update(new_tax)
            for name, value in new_deductions.items():
                self.deductions.updateValue((name,), value)
            if current_period is not None and (moved >= 0 or current_period in emitted) and self.gross.containsKey((current_period,)):
                row = dict(zip(gross_schema.fieldNames(), self.gross.getValue((current_period,)), strict=True))
                emitted[current_period] = {**row, **self._settings(tax, deductions), "emitted_off": max(row["last_off"], moved)}
            if gone:
                emitted = {p: {"pay_period_number": p, "deleted": True} for p in {*known, *emitted}}
            for row in emitted.values():
                full = {"deleted": False, **row, "employee_id": employee}
                yield Row(**{c: full.get(c) for c in columns})

        @staticmethod
        def _settings(tax, deductions: dict) -> dict:
            exact = lambda x: Decimal(repr(float(x))).quantize(cent_of_cents, ROUND_HALF_UP)
            fixed = sum((exact(a) for a, percent, active in deductions.values() if active and not percent), Decimal(0))
            share = sum((exact(a / 100.0) for a, percent, active in deductions.values() if active and percent), Decimal(0))
            named = dict(zip(tax_schema.fieldNames(), tax, strict=True)) if tax is not None else {}
            return {**named, "fixed_total": float(fixed), "percent_share": float(share)}

        def close(self) -> None:
            pass

    return EmployeePay()


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB as state store of the queries started inside; the session's own setting returns."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def start_states(spark: SparkSession, source: SignalStream, net: BatchStore, checkpoint: str, current_period: int | None = None) -> StreamingQuery:
    """Second half: signals written so far go into the states; every batch writes the net-pay rows it gives reason for."""
    read = spark.readStream.schema(SIGNALS).parquet(f"{source.signals.path}/*")
    configured = read.groupBy("employee_id").transformWithState(
        statefulProcessor=_processor(current_period), outputStructType=CONFIGURED, outputMode="Update", timeMode="None"
    )

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            live = netpay.breakdown(rows.filter(~F.col(DELETED)).drop(DELETED)).withColumn(DELETED, F.lit(False))
            dead = rows.filter(DELETED).select("employee_id", "pay_period_number", DELETED)
            both = live.withColumn("off", F.col("emitted_off")).unionByName(dead, allowMissingColumns=True)
            net.write(both.select(*NET.fieldNames()), batch_id)
        finally:
            rows.unpersist()

    writer = configured.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with _state_store(spark):
        return writer.trigger(availableNow=True).start()
