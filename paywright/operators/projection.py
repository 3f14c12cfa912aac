"""Idempotent read model: which events count, the employee record, pay attributes, and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywright.functions.ordered import BLOCK_ROWS, Running, with_running
from paywright.functions.scalars import as_flag, change_type
from paywright.functions.skew import join_one_per_key
from paywright.schemas import EMPLOYEE_EVENTS, NET_PAY_AMOUNTS
from paywright.sources.event_log import resolve_identity

GUID = "^[{(]?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}[)}]?$"

_FIELD_EVENTS = ["employee.created", "employee.updated"]

MONEY_COLUMNS = [*NET_PAY_AMOUNTS, "pay_rate", "total_hours_worked"]


def employee_changes(events: DataFrame) -> DataFrame:
    """The four employee events with their identity, flattened to what the record needs."""
    names = ["FirstName", "LastName", "Email", "PayType", "PayRate", "PayPeriodHours", "IsActive"]
    text = lambda name: F.coalesce(name, F.lit(""))
    fields = F.struct(
        text("FirstName").alias("first_name"),
        text("LastName").alias("last_name"),
        text("Email").alias("email"),
        text("PayType").alias("pay_type"),
        F.col("PayRate").try_cast("decimal(18,2)").alias("pay_rate"),
        F.coalesce(F.col("PayPeriodHours").try_cast("decimal(18,2)"), F.lit(40).cast("decimal(18,2)")).alias(
            "pay_period_hours"
        ),
    )
    name = F.col("event_type")
    active = (
        F.when(name == "employee.deactivated", F.lit(False))
        .when(name == "employee.activated", F.lit(True))
        .otherwise(as_flag(F.col("IsActive"), True))
    )
    usable = name.isin(EMPLOYEE_EVENTS) & F.col("employee_id").isNotNull() & F.col("occurred_on").isNotNull()
    return resolve_identity(events, *names).filter(usable).select(
        "off", "employee_id", "event_id", "event_type", "occurred_on", active.alias("is_active"),
        F.when(name.isin(_FIELD_EVENTS), fields).alias("fields"),
    )


def first_deliveries(changes: DataFrame) -> DataFrame:
    """Drop repeated deliveries of an event, keeping the first by offset.

    Reduced on the map side, so an event delivered millions of times costs one row per map task.
    """
    rest = [c for c in changes.columns if c not in ("employee_id", "event_id")]
    first = F.min_by(F.struct(*rest), "off").alias("_row")
    return (
        changes.groupBy("employee_id", "event_id").agg(first).select("employee_id", "event_id", "_row.*").select(*changes.columns)
    )


def accepted_events(changes: DataFrame, prior: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Events strictly newer than everything accepted before them, in arrival order.

    Ties lose to the earlier arrival. An event id stands for one event, so a repeated delivery carries the same timestamp
    and is never newer than itself. ``prior`` (employee_id, last_event_timestamp) holds what earlier batches accepted.
    """
    highest = {"_seen": Running("max", F.col("occurred_on"))}
    seen = with_running(first_deliveries(changes), ["employee_id"], highest, block_rows=block_rows)
    if prior is not None:
        before = prior.select("employee_id", F.col("last_event_timestamp").alias("_prior"))
        seen = join_one_per_key(seen, before, ["employee_id"]).withColumn("_seen", F.greatest("_seen", "_prior"))
    newer = F.col("_seen").isNull() | (F.col("occurred_on") > F.col("_seen"))
    return seen.filter(newer).select(*changes.columns)


def record_partials(accepted: DataFrame) -> DataFrame:
    """Per employee, what a set of accepted events says about its record; partials of disjoint sets merge."""
    off = F.col("off")
    gone = F.col("event_type") == "employee.deactivated"
    return accepted.groupBy("employee_id").agg(
        F.max_by(F.struct(off.alias("off"), F.col("fields").alias("v")), F.when(F.col("fields").isNotNull(), off)).alias(
            "fields"
        ),
        F.max_by(F.struct(off.alias("off"), "event_type", "occurred_on", "event_id", "is_active"), off).alias("last"),
        F.min_by(F.struct(off.alias("off"), "occurred_on"), off).alias("first"),
        F.max(F.when(gone, off)).alias("last_deactivated_off"),
    )


def merge_record_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("employee_id").agg(
        F.max_by("fields", F.col("fields.off")).alias("fields"),
        F.max_by("last", F.col("last.off")).alias("last"),
        F.min_by("first", F.col("first.off")).alias("first"),
        F.max("last_deactivated_off").alias("last_deactivated_off"),
    )


def record_from_partials(partials: DataFrame) -> DataFrame:
    """Records from merged partials, one per employee."""
    text = lambda c: F.coalesce(F.col(f"fields.v.{c}"), F.lit("")).alias(c)
    return partials.select(
        "employee_id",
        *[text(c) for c in ("first_name", "last_name", "email", "pay_type")],
        F.col("fields.v.pay_rate").alias("pay_rate"),
        F.coalesce("fields.v.pay_period_hours", F.lit(40).cast("decimal(18,2)")).alias("pay_period_hours"),
        F.col("last.is_active").alias("is_active"),
        F.col("last.event_type").alias("last_event_type"),
        F.col("last.occurred_on").alias("last_event_timestamp"),
        F.col("last.event_id").alias("last_event_id"),
        F.col("first.occurred_on").alias("created_at"),
        F.col("last.occurred_on").alias("updated_at"),
        F.col("first.off").alias("first_off"),
        F.col("last.off").alias("last_off"),
        "last_deactivated_off",
    )


def employee_record(accepted: DataFrame) -> DataFrame:
    """One record per employee from its accepted events.

    Created and updated events set every field; activated and deactivated ones set only the flag. A record that begins
    with either has blank fields. The reference clock of the audit columns is the event time, so a replay gives the same
    rows. ``first_off`` and ``last_deactivated_off`` order the record against other logs.
    """
    return record_from_partials(record_partials(accepted))


def valid_pay_rows(net_pay: DataFrame) -> DataFrame:
    """Net-pay rows whose employee id is a GUID; others are dropped by the read model."""
    return net_pay.filter(F.col("employee_id").rlike(GUID))


def pay_changes(net_pay: DataFrame, accepted: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Net-pay rows that count, in arrival order: the employee is known by then, and no newer period was seen before.

    Every accepted deactivation of the employee forgets which period was newest. ``accepted`` are the employee's
    accepted events; offsets of both inputs are of one log. A pay row follows the event that caused it, so of an event
    and a pay row with the same offset the event comes first.
    """
    keys = ["employee_id"]
    marks = accepted.select(
        "employee_id", "off", F.lit(1).alias("_event"), (F.col("event_type") == "employee.deactivated").cast("int").alias("_reset")
    )
    rows = valid_pay_rows(net_pay).withColumns({"_event": F.lit(0), "_reset": F.lit(0)})
    before = {
        "_known": Running("max", F.col("_event"), include_current=True),
        "_segment": Running("sum", F.col("_reset"), include_current=True),
    }
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_at", F.col("off") * 2 + 1 - F.col("_event"))
    placed = with_running(both, keys, before, offset="_at", block_rows=block_rows)
    live = placed.filter((F.col("_event") == 0) & (F.col("_known") == 1)).drop("_event", "_reset", "_known")
    newest = {"_newest": Running("max", F.col("pay_period_number"))}
    seen = with_running(live, [*keys, "_segment"], newest, block_rows=block_rows)
    counts = F.col("_newest").isNull() | (F.col("pay_period_number") >= F.col("_newest"))
    return seen.filter(counts).select(*net_pay.columns)


def pay_attributes(net_pay: DataFrame, records: DataFrame) -> DataFrame:
    """The pay row each employee shows: highest period since the last deactivation, its latest arrival.

    A deactivation deletes the row and so forgets which period was highest. Accepting "this period or later" one by one
    ends at the same row as the maximum over (period, arrival), which combines on the map side. Rows that arrive before
    the employee record exists have nothing to attach to; the row caused by the very event that made the record counts.
    """
    known = records.select("employee_id", "first_off", F.coalesce("last_deactivated_off", F.lit(-1)).alias("_reset"))
    rows = valid_pay_rows(net_pay)
    live = join_one_per_key(rows, known, ["employee_id"], "inner").filter(
        (F.col("off") > F.col("_reset")) & (F.col("off") >= F.col("first_off"))
    )
    values = [c for c in rows.columns if c != "employee_id"]
    best = F.max_by(F.struct(*values), F.struct("pay_period_number", "off")).alias("_row")
    shown = live.groupBy("employee_id").agg(best).select("employee_id", "_row.*")
    return shown.withColumns({c: F.col(c).cast("decimal(18,2)") for c in MONEY_COLUMNS})


def employees_with_pay(records: DataFrame, pay: DataFrame) -> DataFrame:
    """Employee records with their pay row as a struct, NULL where there is none."""
    nested = pay.select("employee_id", F.struct(*[c for c in pay.columns if c != "employee_id"]).alias("pay_attributes"))
    return records.join(nested, "employee_id", "left")


def sort_by(df: DataFrame, *specs: tuple[str, str]) -> DataFrame:
    """Caller-defined order: (field, 'ASC' or 'DESC') pairs, nested fields by path; NULLs first when ascending."""
    directions = {"ASC": lambda c: c.asc_nulls_first(), "DESC": lambda c: c.desc_nulls_last()}
    return df.orderBy(*[directions[way.upper()](F.col(path)) for path, way in specs])


def change_feed(accepted: DataFrame, net_pay: DataFrame | None = None) -> DataFrame:
    """One row per accepted event, plus ``payUpdated`` rows for the pay rows that count."""
    feed = accepted.select("off", "employee_id", change_type(F.col("event_type")).alias("change_type"))
    if net_pay is None:
        return feed
    paid = pay_changes(net_pay, accepted)
    return feed.unionByName(paid.select("off", "employee_id", F.lit("payUpdated").alias("change_type")))


def newest(feed: DataFrame, n: int = 50) -> DataFrame:
    return feed.orderBy(F.desc("off"), "employee_id", "change_type").limit(n)


def cascade_deactivation(pay: DataFrame, deactivated: DataFrame) -> DataFrame:
    """Pay rows without those of deactivated employees."""
    return pay.join(deactivated, "employee_id", "left_anti")
