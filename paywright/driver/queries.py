"""Registered queries over the driver's tables: one callable per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright import schemas
from paywright.driver import tables
from paywright.functions import labels, periods, scalars, tax
from paywright.operators import checks, extract, lookups, netpay, people, projection
from paywright.plans import filters
from paywright.plans.payroll import Payroll
from paywright.plans.search_documents import last_pay_periods, search_hits
from paywright.session import materialize
from paywright.sources import changelog, event_log

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _payroll(spark: SparkSession, sf: str) -> Payroll:
    return Payroll(lambda *entities: tables.events(spark, sf, *entities))


def _seconds(ts: Column) -> Column:
    """Timestamps leave as epoch seconds, which both engines print alike."""
    return F.unix_seconds(ts)


# Sources and projections ---------------------------------------------------------------------------------------------


@query
def raw_entities(spark, sf):
    """Every entity table of the log, in one listing."""
    ev = lambda entity: tables.events(spark, sf, entity)
    parts = {
        "employee": extract.employees(ev("employee")).select(
            "id", F.col("id").alias("employee_id"), F.col("pay_rate").cast("double").alias("amount"),
            "is_active", _seconds(F.col("updated_at")).alias("updated"),
        ),
        "timeentry": extract.time_entries(ev("timeentry")).select(
            "id", "employee_id", F.col("hours_worked").cast("double").alias("amount"),
            F.col("clock_out").isNull().alias("is_active"), _seconds(F.col("updated_at")).alias("updated"),
        ),
        "taxinfo": extract.tax_information(ev("taxinfo")).select(
            "id", "employee_id", F.col("additional_federal_withholding").cast("double").alias("amount"),
            (F.col("state") != "").alias("is_active"), _seconds(F.col("updated_at")).alias("updated"),
        ),
        "deduction": extract.deductions(ev("deduction")).select(
            "id", "employee_id", F.col("amount").cast("double").alias("amount"), "is_active",
            _seconds(F.col("updated_at")).alias("updated"),
        ),
    }
    return lookups.union_tagged("entity", **parts)


@query
def demux_counts(spark, sf):
    branches = extract.demux(tables.events(spark, sf))
    return lookups.union_tagged("branch", **branches).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query
def event_topic_routing(spark, sf):
    return event_log.route(tables.events(spark, sf)).groupBy("topic", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def event_identity(spark, sf):
    found = event_log.resolve_identity(tables.events(spark, sf))
    return found.select("off", "employee_id", "event_id", "event_type", F.unix_micros("occurred_on").alias("occurred_us"))


@query
def employee_info(spark, sf):
    return _payroll(spark, sf).employees()


@query
def time_entry_events(spark, sf):
    return extract.time_entry_events(tables.events(spark, sf, "timeentry"))


@query
def gross_pay_events(spark, sf):
    return extract.gross_pay_events(tables.events(spark, sf, "timeentry", "employee"))


@query
def period_bounds(spark, sf):
    """Period number, bounds and the equal Spark window of every event."""
    ts = F.col("ts").cast("timestamp")
    number = periods.period_of(F.date_trunc("second", ts))
    rows = tables.table(spark, sf, "events").select(
        number.alias("pay_period_number"), periods.tumbling_window(ts)["start"].alias("window_start")
    )
    counted = rows.groupBy("pay_period_number", "window_start").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "pay_period_number", _seconds(F.col("window_start")).alias("window_start"), "n",
        periods.period_start(F.col("pay_period_number")).alias("pay_period_start"),
        periods.period_end(F.col("pay_period_number")).alias("pay_period_end"),
    )


@query
def hours_worked(spark, sf):
    """Hours between order date and ship date of every line item, with the check that rejects non-positive spans."""
    lines = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    spans = lines.join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber",
        F.col("o_orderdate").cast("timestamp").alias("clock_in"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_orderkey") % 3600)).alias("clock_out"),
    )
    return checks.check_hours(spans).select(
        "l_orderkey", "l_linenumber", F.col("hours_worked").cast("double").alias("hours_worked"), "rejected"
    )


@query
def key_parse(spark, sf):
    """Employee ids out of the three forms a record key may take."""
    forms = tables.table(spark, sf, "events").select(
        "event_id", tables.employee_key(F.col("user_id")).alias("employee_id"), (F.col("event_id") % 3).alias("form")
    )
    key = (
        F.when(F.col("form") == 0, F.to_json(F.struct(F.col("employee_id").alias("EMPLOYEE_ID"), F.lit(1).alias("PAY_PERIOD_NUMBER"))))
        .when(F.col("form") == 1, F.concat(F.lit('"'), F.col("employee_id"), F.lit('"')))
        .otherwise(F.col("employee_id"))
    )
    return forms.select("event_id", changelog.employee_of_key(key).alias("employee_id"))


# Hours, gross pay, tax, deductions, net pay --------------------------------------------------------------------------


@query
def hours_by_period(spark, sf):
    return _payroll(spark, sf).hours()


@query
def gross_pay_by_period(spark, sf):
    return _payroll(spark, sf).gross_pay().drop("last_off")


@query
def deduction_state(spark, sf):
    return people.deduction_state(_payroll(spark, sf).deduction_events())


@query
def deduction_totals(spark, sf):
    return _payroll(spark, sf).deduction_totals()


@query
def active_deductions(spark, sf):
    listed = extract.deductions(tables.events(spark, sf, "deduction"))
    return people.active_deduction_count(listed.filter("employee_id is not null"))


@query
def tax_state(spark, sf):
    return _payroll(spark, sf).tax_state().drop("off")


def _incomes(spark, sf) -> DataFrame:
    """Order values as incomes of one period, with a filing status and a state."""
    key = F.col("o_orderkey")
    return tables.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 20).alias("gross_pay"),
        tables.pick(tables.FILINGS, key).alias("filing"), tables.pick(tables.STATES, key).alias("state"),
    )


@query
def federal_tax(spark, sf):
    """Progressive tax as one expression."""
    return _incomes(spark, sf).select(
        "o_orderkey", tax.federal_tax("gross_pay", "filing").alias("federal_tax")
    )


@query
def federal_tax_lookup(spark, sf):
    """The same tax by range join with the bracket table."""
    return tax.with_federal_tax_by_lookup(_incomes(spark, sf), "gross_pay", "filing").select("o_orderkey", "federal_tax")


@query
def state_tax(spark, sf):
    return tax.with_state_rate(_incomes(spark, sf), "state").select(
        "o_orderkey", "state_rate", tax.state_tax_at(F.col("gross_pay"), F.col("state_rate")).alias("state_tax")
    )


@query
def net_pay(spark, sf):
    return _payroll(spark, sf).net_pay().drop("last_off")


@query
def net_pay_asof(spark, sf):
    return _payroll(spark, sf).net_pay("asof", current_period=2).drop("last_off", "emitted_off")


@query
def current_period_recompute(spark, sf):
    p = _payroll(spark, sf)
    return netpay.current_period_recompute(
        p.gross_pay(), p.tax_events(), p.deduction_events(), p.tax_state(), p.deduction_totals(), 2
    ).drop("last_off")


@query
def net_pay_lookup(spark, sf):
    """Net pay of the keys that orders ask for: each customer in the period of the order's day of the year."""
    asked = tables.table(spark, sf, "orders").select(
        tables.employee_key(F.col("o_custkey")).alias("employee_id"),
        (F.dayofyear("o_orderdate") % 4).cast("bigint").alias("pay_period_number"),
    )
    found = lookups.get_many(_payroll(spark, sf).net_pay(), asked, schemas.NET_PAY_KEYS)
    return found.select("employee_id", "pay_period_number", "gross_pay", "net_pay")


@query
def tombstones(spark, sf):
    """Keys of net-pay rows that deactivation deletes."""
    p = _payroll(spark, sf)
    return netpay.purge(p.gross_pay().select("employee_id", "pay_period_number"), p.deactivated()).select("key", "value")


@query
def compacted_table(spark, sf):
    """Time entries as a compacted topic: written as JSON key and value, read back, tombstones applied."""
    rows = extract.time_entry_events(tables.events(spark, sf, "timeentry"))
    rows = rows.select("time_entry_id", "off", "employee_id", "hours_worked", "pay_period_number", "clock_out_time")
    changes = changelog.to_changelog(rows, ["time_entry_id"], deleted=F.col("clock_out_time").isNull())
    table = changelog.table_from_changelog(changes, ["key"])
    return changelog.parse_changelog(
        table,
        T.StructType([T.StructField("time_entry_id", T.StringType())]),
        T.StructType([
            T.StructField("employee_id", T.StringType()), T.StructField("hours_worked", T.DoubleType()),
            T.StructField("pay_period_number", T.LongType()),
        ]),
    )


@query
def upsert_table(spark, sf):
    """Time-entry states of periods 0 and 1 as target, later ones as changes, entries left open as deletes."""
    rows = extract.time_entry_events(tables.events(spark, sf, "timeentry")).select(
        "time_entry_id", "off", "hours_worked", "pay_period_number", F.col("clock_out_time").isNull().alias("gone")
    )
    early = rows.filter((F.col("pay_period_number") < 1) & ~F.col("gone"))
    target = early.groupBy("time_entry_id").agg(F.max_by("hours_worked", "off").alias("hours_worked"))
    return changelog.upsert(target, rows.filter("pay_period_number >= 1"), ["time_entry_id"], F.col("gone"))


@query
def deactivated_employees(spark, sf):
    return _payroll(spark, sf).deactivated()


@query
def replay_stats(spark, sf):
    return people.replay_stats(tables.raw_log(spark, sf), tables.events(spark, sf, "employee"))


@query
def directory_stats(spark, sf):
    return people.directory_stats(extract.employees(tables.events(spark, sf, "employee")))


@query
def directory_labels(spark, sf):
    """Employees by pay type label and deductions by type label."""
    staff = extract.employees(tables.events(spark, sf, "employee")).select(
        F.lit("pay_type").alias("code_set"), labels.pay_type_label(F.col("pay_type")).alias("label")
    )
    ded = extract.deductions(tables.events(spark, sf, "deduction")).select(
        F.lit("deduction_type").alias("code_set"), labels.deduction_type_label(F.col("deduction_type")).alias("label")
    )
    return staff.union(ded).groupBy("code_set", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def total_hours(spark, sf):
    listed = extract.time_entries(tables.events(spark, sf, "timeentry"))
    return people.total_hours(listed).select("employee_id", F.col("total_hours").cast("double").alias("total_hours"))


@query
def clocked_in(spark, sf):
    return people.clocked_in(extract.time_entries(tables.events(spark, sf, "timeentry")))


# Read model ----------------------------------------------------------------------------------------------------------


def _accepted(spark, sf) -> DataFrame:
    log = tables.redelivered(tables.raw_log(spark, sf, "employee"))
    return projection.accepted_events(projection.employee_changes(event_log.events_of(log)))


def _pay_rows(spark, sf) -> DataFrame:
    """Net pay as a log: each row arrives with the event that caused it (offsets doubled like the re-sent log's)."""
    rows = _payroll(spark, sf)
    gross = materialize(rows.gross_pay(), "gross-pay")
    paid = netpay.net_pay_asof(gross, rows.tax_events(), rows.deduction_events(), current_period=2)
    return paid.withColumn("off", F.col("emitted_off") * 2).drop("last_off", "emitted_off")


@query
def accepted_events(spark, sf):
    return _accepted(spark, sf).select("off", "employee_id", "event_id", "event_type", F.unix_micros("occurred_on").alias("occurred_us"))


@query
def employee_record(spark, sf):
    record = projection.employee_record(_accepted(spark, sf))
    return record.select(
        "employee_id", "first_name", "last_name", "email", "pay_type", F.col("pay_rate").cast("double").alias("pay_rate"),
        F.col("pay_period_hours").cast("double").alias("pay_period_hours"), "is_active", "last_event_type", "last_event_id",
        F.unix_micros("last_event_timestamp").alias("last_event_us"), F.unix_micros("created_at").alias("created_us"),
    )


@query
def pay_attributes(spark, sf):
    shown = projection.pay_attributes(_pay_rows(spark, sf), projection.employee_record(_accepted(spark, sf)))
    return shown.select("employee_id", "pay_period_number", *[
        F.col(c).cast("double").alias(c) for c in ("gross_pay", "total_tax", "total_deductions", "net_pay")
    ])


def _records_with_pay(spark, sf) -> DataFrame:
    records = projection.employee_record(_accepted(spark, sf))
    return projection.employees_with_pay(records, projection.pay_attributes(_pay_rows(spark, sf), records))


@query
def employees_with_pay(spark, sf):
    whole = projection.sort_by(_records_with_pay(spark, sf), ("pay_attributes.net_pay", "DESC"), ("employee_id", "ASC"))
    return whole.select(
        "employee_id", "email", "is_active", F.col("pay_attributes.pay_period_number").alias("pay_period_number"),
        F.col("pay_attributes.net_pay").cast("double").alias("net_pay"),
    )


@query
def filter_generic(spark, sf):
    """Employees by a nested where object over the record and its pay row."""
    where = {
        "or": [
            {"and": [{"first_name": {"startsWith": "mary"}}, {"is_active": {"eq": True}}]},
            {"pay_attributes": {"net_pay": {"gt": 3000}}, "email": {"ncontains": "grace"}},
            {"last_name": {"in": ["worker7", "Worker42", "WORKER99"]}},
        ],
        "pay_rate": {"nlt": 20},
    }
    records = _records_with_pay(spark, sf)
    return records.filter(filters.compile_where(where, records.schema)).select("employee_id", "first_name", "last_name")


@query
def change_feed(spark, sf):
    return projection.change_feed(materialize(_accepted(spark, sf), "accepted"), _pay_rows(spark, sf))


@query
def change_feed_newest(spark, sf):
    return projection.newest(change_feed(spark, sf))


@query
def cascade_deactivation(spark, sf):
    """Pay rows that survive the deactivation of their employee."""
    paid = _pay_rows(spark, sf).select("employee_id", "pay_period_number", "net_pay")
    return projection.cascade_deactivation(paid, _payroll(spark, sf).deactivated())


# Search --------------------------------------------------------------------------------------------------------------


def _documents(spark, sf, include_inactive: bool = True) -> DataFrame:
    return _payroll(spark, sf).documents(include_inactive)


@query
def last4_pay_periods(spark, sf):
    """Newest periods per employee; two of them, since the log spans only three."""
    return last_pay_periods(_payroll(spark, sf).net_pay(), 2).select("employee_id", "pay_period_number", "net_pay")


@query
def search_documents(spark, sf):
    """One row per document and nested pay period, outer so that documents without pay stay."""
    return _documents(spark, sf, False).select(
        "employee_id", "first_name", "last_name", "email", "pay_type", "pay_rate", "pay_period_hours", "hire_date",
        F.explode_outer("pay_periods").alias("p"),
    ).select(
        *["employee_id", "first_name", "last_name", "email", "pay_type", "pay_rate", "pay_period_hours", "hire_date"],
        F.col("p.pay_period_number").alias("pay_period_number"), F.col("p.net_pay").alias("net_pay"),
        F.col("p.pay_period_start").alias("pay_period_start"),
    )


@query
def search_hits_projection(spark, sf):
    hits = search_hits(_documents(spark, sf))
    return hits.select(
        "id", "firstName", "payType", "payRate", "isActive", F.size("payPeriods").cast("bigint").alias("periods"),
        F.round(F.aggregate("payPeriods", F.lit(0.0), lambda total, p: total + p["netPay"]), 2).alias("netPaySum"),
    )


def _search_simple(spark, sf) -> DataFrame:
    docs = _documents(spark, sf)
    return docs.filter(filters.compile_simple(" Mary A ", filters.searchable_fields(docs.schema), "active", "1"))


@query
def search_simple(spark, sf):
    return _search_simple(spark, sf).select("employee_id", "first_name", "pay_type")


@query
def search_simple_keyword(spark, sf):
    """Free text that only the e-mail address contains, next to a phrase prefix on names."""
    docs = _documents(spark, sf)
    asked = filters.compile_simple("r.1", filters.searchable_fields(docs.schema))
    return docs.filter(asked).select("employee_id", "email")


@query
def search_page(spark, sf):
    """First 200 of all documents with the number of hits."""
    docs = _documents(spark, sf)
    everything = docs.filter(filters.compile_simple("", filters.searchable_fields(docs.schema)))
    return filters.page(everything).select("employee_id", "email", "total_hits")


def _cond(field, operator, value, value2="") -> dict:
    return {"type": "condition", "field": field, "operator": operator, "value": value, "value2": value2}


def _group(operator, *children) -> dict:
    return {"type": "group", "operator": operator, "children": list(children)}


@query
def search_advanced(spark, sf):
    tree = _group(
        "OR",
        _group(
            "AND", _cond("first_name", "starts_with", "Gra"), _cond("pay_rate", "gte", "30.5"), _cond("is_active", "is", "true")
        ),
        _group(
            "AND", _cond("hire_date", "between", "2020-06-01", "2020-12-31"), _cond("pay_type", "is_not", "2"),
            _cond("email", "contains", "ADA"), _cond("pay_rate", "neq", "abc"), _group("OR", _cond("", "", "")),
        ),
        _group("AND", _cond("last_name", "equals", "Worker17"), _cond("hire_date", "after", "2020-03-04")),
    )
    return filters.search(_documents(spark, sf), tree).select("employee_id", "first_name", "hire_date")


@query
def search_nested(spark, sf):
    tree = _group(
        "AND", _cond("pay_periods.net_pay", "gt", "1000"), _cond("pay_periods.pay_type", "equals", "1"),
        _cond("pay_periods.pay_period_number", "neq", 0), _cond("pay_periods.pay_period_start", "after", "2024-01-10"),
    )
    return filters.search(_documents(spark, sf), tree).select("employee_id", "pay_type")


# Lookups, merges, checks ---------------------------------------------------------------------------------------------


@query
def employee_lookup(spark, sf):
    """Employees that customers with a positive balance ask for."""
    asked = tables.table(spark, sf, "customer").filter("c_acctbal > 0").select(
        tables.employee_key(F.col("c_custkey")).alias("id")
    )
    found = lookups.get_many(extract.employees(tables.events(spark, sf, "employee")), asked, ["id"])
    return found.select("id", "first_name", "last_name", "pay_type")


@query
def time_entries_sorted(spark, sf):
    listed = lookups.entries_of(extract.time_entries(tables.events(spark, sf, "timeentry")))
    return listed.select("employee_id", "id", F.unix_micros("clock_in").alias("clock_in_us"))


@query
def open_entry(spark, sf):
    found = lookups.open_entry(extract.time_entries(tables.events(spark, sf, "timeentry")))
    return found.select("employee_id", "id", F.unix_micros("clock_in").alias("clock_in_us"))


@query
def audit_history(spark, sf):
    history = lookups.audit_history(extract.employee_info_events(tables.events(spark, sf, "employee")))
    return history.select("off", "employee_id", "event_type", "pay_rate", "previous_rate")


@query
def fallback_read(spark, sf):
    """Employees from the log, customers where the log has none."""
    first = extract.employees(tables.events(spark, sf, "employee")).select(
        "id", F.concat_ws(" ", "first_name", "last_name").alias("name"), F.col("pay_rate").cast("double").alias("amount")
    )
    second = tables.table(spark, sf, "customer").select(
        tables.employee_key(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount")
    )
    return lookups.prefer(first, second, "id")


@query
def merge_snapshot(spark, sf):
    """Customers as snapshot, current employees as changes."""
    snapshot = tables.table(spark, sf, "customer").select(
        tables.employee_key(F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("pay_rate"),
    )
    incoming = extract.employees(tables.events(spark, sf, "employee")).select(
        "id", F.concat_ws(" ", "first_name", "last_name").alias("name"), F.col("pay_rate").cast("double").alias("pay_rate")
    )
    return lookups.merge_changes(snapshot, incoming, "id")


@query
def union_outputs(spark, sf):
    """Employee and net-pay changelogs side by side, counted by topic and shape."""
    p = _payroll(spark, sf)
    info = p.employees().withColumn("off", F.lit(0).cast("bigint"))
    paid = p.net_pay().withColumnRenamed("last_off", "off")
    gone = netpay.purge(p.gross_pay(), p.deactivated())
    logs = lookups.union_tagged(
        "topic",
        employee_info=changelog.to_changelog(info, ["employee_id"]),
        net_pay=changelog.to_changelog(paid, schemas.NET_PAY_KEYS).unionByName(gone),
    )
    return logs.groupBy("topic").agg(
        F.count(F.lit(1)).alias("records"), F.count("value").alias("live"),
        F.sum(F.length("key")).alias("key_chars"),
    )


@query
def ref_check(spark, sf):
    """Deduction events against employees created before them."""
    rows = _payroll(spark, sf).deduction_events()
    known = extract.employee_info_events(tables.events(spark, sf, "employee")).filter(F.col("event_type") == "employee.created")
    return checks.check_reference(rows, known, "employee_id").select("off", "employee_id", "accepted")


@query
def target_check(spark, sf):
    """Updates and deactivations of deductions against the deductions created before them."""
    rows = _payroll(spark, sf).deduction_events()
    made = F.col("event_type") == "deduction.created"
    return checks.check_reference(rows.filter(~made), rows.filter(made), "deduction_id").select("off", "deduction_id", "accepted")


@query
def uniqueness_check(spark, sf):
    """Second tax rows, and clock events that do not fit what the employee did before."""
    tax_rows = _payroll(spark, sf).tax_events().select("off", "employee_id")
    first = checks.check_first_per_key(tax_rows, "employee_id").withColumn("rule", F.lit("tax"))
    clock = event_log.with_fields(tables.events(spark, sf, "timeentry"), "EmployeeId").select(
        "off", F.col("EmployeeId").alias("employee_id"),
        F.when(F.col("event_type") == "timeentry.clockedin", "in").otherwise("out").alias("action"),
    )
    fits = checks.check_clock_events(clock).drop("action").withColumn("rule", F.lit("clock"))
    return first.unionByName(fits)


@query
def scalar_functions(spark, sf):
    """Scalar functions not visible elsewhere, over all line items."""
    price = F.col("l_extendedprice")
    ids = F.array("l_returnflag", "l_linestatus", "l_returnflag")
    last_wins = scalars.map_last_wins(ids, F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)))
    line = tables.table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber",
        scalars.round_cents(price * F.col("l_discount")).alias("half_up"),
        scalars.round_half_even((price * 100).cast("decimal(18,0)") / 8000).cast("double").alias("half_even"),
        scalars.sum_array(F.map_values(last_wins)).alias("map_sum"),
        F.floor(price).alias("floored"),
        F.substring("l_linestatus", 1, 1).alias("head"),
        scalars.strip_quotes(F.concat(F.lit('"'), "l_returnflag", F.lit('"'))).alias("unquoted"),
        scalars.unless_false(F.when(F.col("l_returnflag") == "N", "FALSE").otherwise(F.col("l_returnflag"))).alias("flag"),
        scalars.change_type(F.concat_ws(".", "l_linestatus", "l_returnflag")).alias("after_dot"),
        scalars.as_double(F.concat("l_returnflag", F.lit("1"))).alias("not_a_number"),
        F.least(price, F.lit(20000.0)).alias("capped"),
        F.greatest(price, F.lit(20000.0)).alias("raised"),
    )
