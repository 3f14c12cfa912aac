"""Net pay: gross pay minus tax minus deductions, with tombstones for deactivated employees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywright.functions.scalars import round_cents
from paywright.functions.skew import join_one_per_key
from paywright.functions.tax import federal_tax, state_tax
from paywright.operators.extract import gross_defaults
from paywright.schemas import NET_PAY_KEYS, NET_PAY_VALUE
from paywright.sources.changelog import tombstones

_TAX_COLUMNS = [
    "federal_filing_status", "state", "additional_federal_withholding", "additional_state_withholding",
]
_FOREVER = (1 << 63) - 1


def breakdown(configured: DataFrame) -> DataFrame:
    """Gross rows with tax and deduction columns attached (NULL where absent) to full net-pay rows.

    Totals are taken before rounding, except that both taxes are already rounded when they enter the total.
    """
    gross = F.col("gross_pay")
    has_tax = F.col("federal_filing_status").isNotNull()
    zero = F.lit(0.0)
    amounts = gross_defaults(configured).withColumns(
        {
            "federal_tax": F.when(has_tax, federal_tax("gross_pay", "federal_filing_status")).otherwise(zero),
            "state_tax": F.when(has_tax, state_tax(gross, F.col("state"))).otherwise(zero),
            "additional_federal_withholding": F.coalesce("additional_federal_withholding", zero),
            "additional_state_withholding": F.coalesce("additional_state_withholding", zero),
            "total_fixed_deductions": F.coalesce("fixed_total", zero),
            "total_percent_deductions": F.coalesce("percent_share", zero) * gross,
        }
    )
    total_tax = (
        F.col("federal_tax") + F.col("state_tax")
        + F.col("additional_federal_withholding") + F.col("additional_state_withholding")
    )
    totals = amounts.withColumns(
        {
            "total_tax": total_tax,
            "total_deductions": F.col("total_fixed_deductions") + F.col("total_percent_deductions"),
        }
    )
    net = totals.withColumn("net_pay", gross - F.col("total_tax") - F.col("total_deductions"))
    rounded = [
        round_cents(F.col(f.name)).alias(f.name) if i < 10 else F.col(f.name) for i, f in enumerate(NET_PAY_VALUE)
    ]
    extra = [c for c in ("last_off", "emitted_off") if c in configured.columns]
    return net.select(*NET_PAY_KEYS, *rounded, *extra)


def net_pay(
    gross: DataFrame,
    tax_state: DataFrame,
    deduction_totals: DataFrame,
    deactivated: DataFrame | None = None,
) -> DataFrame:
    """Every gross row with the *latest* tax settings and deductions; deactivated employees are left out.

    All inputs are aggregates: few rows per employee on the left, one on the right. Spark broadcasts a right side only
    where its measured size allows it.
    """
    live = gross if deactivated is None else gross.join(deactivated, "employee_id", "left_anti")
    settings = tax_state.select("employee_id", *_TAX_COLUMNS)
    return breakdown(live.join(settings, "employee_id", "left").join(deduction_totals, "employee_id", "left"))


def net_pay_asof(
    gross: DataFrame,
    tax_events: DataFrame,
    deduction_events: DataFrame,
    current_period: int | None = None,
    deactivated: DataFrame | None = None,
) -> DataFrame:
    """Every gross row with the settings in force when it was last computed.

    A row is computed by its own last event (``last_off``). Setting changes recompute only ``current_period``, so rows of
    that period see the latest settings and older ones keep theirs. An employee has few periods; their offsets cut the
    log into slots. Setting events are reduced per slot on the map side, and one window per employee, over the slots
    only, carries the results forward to the gross rows. No window ever sees raw events.

    ``emitted_off`` is the offset of the event that caused the row as it stands: its own last event, or a later setting
    change if that recomputed it. A consumer that lets the later emitted row win orders by it.
    """
    live = gross if deactivated is None else gross.join(deactivated.hint("merge"), "employee_id", "left_anti")
    seen_at = F.col("last_off")
    if current_period is not None:
        seen_at = F.when(F.col("pay_period_number") == current_period, F.lit(_FOREVER)).otherwise(seen_at)
    by_time = Window.partitionBy("employee_id").orderBy("_seen_at")
    probes = live.withColumn("_seen_at", seen_at).withColumn("_slot", F.dense_rank().over(by_time) - 1)
    bounds = probes.groupBy("employee_id").agg(F.array_sort(F.collect_set("_seen_at")).alias("_bounds"))

    changes = probes.withColumn("_probe", F.lit(True))
    for part in (_tax_by_slot(_slotted(tax_events, bounds)), _deductions_by_slot(_slotted(deduction_events, bounds))):
        changes = changes.unionByName(part, allowMissingColumns=True)
    so_far = Window.partitionBy("employee_id").orderBy("_slot").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    settled = changes.withColumns(
        {
            "_tax": F.last("_tax", ignorenulls=True).over(so_far),
            "fixed_total": F.sum("_fixed").over(so_far).cast("double"),
            "percent_share": F.sum("_share").over(so_far).cast("double"),
            "_moved": F.max("_moved").over(so_far),
        }
    ).filter("_probe")
    emitted = F.col("last_off")
    if current_period is not None:
        emitted = F.when(F.col("pay_period_number") == current_period, F.greatest("last_off", "_moved")).otherwise(emitted)
    return breakdown(
        settled.select(*live.columns, "_tax.*", "fixed_total", "percent_share", emitted.alias("emitted_off"))
    )


def _slotted(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events with the first slot that sees them; events after every slot are dropped."""
    placed = join_one_per_key(events, bounds, ["employee_id"], "inner").withColumn(
        "_slot", F.size(F.filter("_bounds", lambda bound: bound < F.col("off")))
    )
    return placed.filter(F.col("_slot") < F.size("_bounds")).drop("_bounds")


def _tax_by_slot(events: DataFrame) -> DataFrame:
    return events.groupBy("employee_id", "_slot").agg(
        F.max_by(F.struct(*_TAX_COLUMNS), "off").alias("_tax"), F.max("off").alias("_moved")
    )


def _deductions_by_slot(events: DataFrame) -> DataFrame:
    """How far each slot moves an employee's totals, in decimals so that a share that ends cancels exactly."""
    key = ["employee_id", "deduction_id"]
    terms = F.struct("amount", "is_percentage")
    newest = events.groupBy(*key, "_slot").agg(
        F.max_by(terms, F.when(F.col("amount").isNotNull(), F.col("off"))).alias("_terms"),
        F.max_by("is_active", "off").alias("_active"),
        F.max("off").alias("_moved"),
    )
    order = Window.partitionBy(*key).orderBy("_slot")
    state = newest.withColumn(
        "_terms", F.last("_terms", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    nothing = F.lit(0).cast("decimal(28,10)")

    def change(applies: Column, amount: Column) -> Column:
        share = F.when(F.col("_active") & applies, amount.cast("decimal(28,10)")).otherwise(nothing)
        return share - F.coalesce(F.lag(share).over(order), nothing)

    moved = state.select(
        "employee_id",
        "_slot",
        "_moved",
        change(~F.col("_terms.is_percentage"), F.col("_terms.amount")).alias("_fixed"),
        change(F.col("_terms.is_percentage"), F.col("_terms.amount") / 100.0).alias("_share"),
    )
    return moved.groupBy("employee_id", "_slot").agg(
        F.sum("_fixed").alias("_fixed"), F.sum("_share").alias("_share"), F.max("_moved").alias("_moved")
    )


def current_period_recompute(
    gross: DataFrame,
    tax_events: DataFrame,
    deduction_events: DataFrame,
    tax_state: DataFrame,
    deduction_totals: DataFrame,
    current_period: int,
) -> DataFrame:
    """Net pay of the current period for the employees whose settings changed, where gross pay exists."""
    changed = tax_events.select("employee_id").union(deduction_events.select("employee_id")).distinct()
    due = gross.filter(F.col("pay_period_number") == current_period).join(changed, "employee_id", "left_semi")
    return net_pay(due, tax_state, deduction_totals)


def purge(net_pay_keys: DataFrame, deactivated: DataFrame) -> DataFrame:
    """Tombstones for every net-pay key of a deactivated employee."""
    return tombstones(net_pay_keys.join(deactivated, "employee_id", "left_semi"), NET_PAY_KEYS)
