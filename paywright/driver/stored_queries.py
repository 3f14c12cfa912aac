"""Registered queries over laid-out data: logs that were landed, tables that were bucketed, indexed or published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright.driver import tables
from paywright.driver.queries import _documents as documents
from paywright.driver.queries import _payroll as payroll_of
from paywright.driver.queries import query
from paywright.driver.stream_queries import feed
from paywright.functions.ranges import join_intervals
from paywright.operators import extract
from paywright.operators.figures import named_records, observed, page_in_one_pass, stream_figures
from paywright.plans import filters
from paywright.plans.payroll import Payroll
from paywright.plans.search_documents import last_pay_periods
from paywright.plans.search_index import SearchIndex
from paywright.schemas import NET_PAY_KEYS
from paywright.session import scratch_dir
from paywright.sources import changelog, event_log
from paywright.sources.bucketed import BucketedPayroll
from paywright.sources.clustered import lookup, write_clustered
from paywright.sources.keyed_table import KeyedTable
from paywright.sources.published import Published
from paywright.streaming import jobs
from paywright.streaming.keyed import SignalStream, start_states
from paywright.streaming.layouts import NET
from paywright.streaming.notices import pay_notices
from paywright.streaming.store import BatchStore

# Landed logs ---------------------------------------------------------------------------------------------------------


def _landed(spark: SparkSession, sf: str, *entities: str) -> str:
    path = scratch_dir(spark, "landed-log")
    event_log.land(tables.raw_log(spark, sf, *entities), path)
    return path


@query
def landed_net_pay(spark, sf):
    """Net pay from a log whose payloads were parsed once, when it was landed."""
    return Payroll.landed(spark, _landed(spark, sf)).net_pay().drop("last_off")


@query
def landed_topics(spark, sf):
    """What a landed log holds, by the folder it lies in."""
    log = spark.read.schema(event_log.LANDED).parquet(_landed(spark, sf))
    return log.groupBy("topic", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def logged_hours(spark, sf):
    """Hours from a log that was written as JSON lines and is scanned from there."""
    path = scratch_dir(spark, "json-log")
    tables.raw_log(spark, sf, "timeentry").write.json(path)
    events = event_log.events_of(event_log.read_events(spark, path, "json"))
    return Payroll.of(events).hours()


@query
def written_changelog(spark, sf):
    """Time entries as a changelog that two runs appended to, read back as a table."""
    path = scratch_dir(spark, "changelog")
    rows = extract.time_entry_events(tables.events(spark, sf, "timeentry"))
    rows = rows.select("time_entry_id", "off", "employee_id", "hours_worked", "clock_out_time")
    changes = changelog.to_changelog(rows, ["time_entry_id"], deleted=F.col("clock_out_time").isNull())
    for run in (0, 1):
        changelog.write_changelog(changes.filter(F.col("off") % 2 == run), path)
    stored = spark.read.schema("off bigint, key string, value string").parquet(path)
    return changelog.parse_changelog(
        changelog.table_from_changelog(stored, ["key"]),
        T.StructType([T.StructField("time_entry_id", T.StringType())]),
        T.StructType([T.StructField("employee_id", T.StringType()), T.StructField("hours_worked", T.DoubleType())]),
    )


# Keyed tables --------------------------------------------------------------------------------------------------------

DEDUCTION_TABLE = T.StructType(
    [T.StructField("employee_id", T.StringType()), T.StructField("deduction_id", T.StringType()), T.StructField("amount", T.DoubleType()),
     T.StructField("is_percentage", T.BooleanType())]
)
BATCHES = 5


@query
def upsert_touched(spark, sf):
    """Deductions after five batches of changes, the last one delivered twice; an ended deduction is a deletion."""
    store = KeyedTable(scratch_dir(spark, "deductions"), DEDUCTION_TABLE, ("employee_id", "deduction_id"), 16)
    changes = extract.deduction_events(tables.events(spark, sf, "deduction")).persist()
    try:
        end = (changes.agg(F.max("off")).first()[0] or 0) + 1
        for batch in [*range(BATCHES), BATCHES - 1]:
            low, high = batch * end // BATCHES, (batch + 1) * end // BATCHES
            part = changes.filter((F.col("off") >= low) & (F.col("off") < high))
            store.upsert(spark, part, F.col("event_type") == "deduction.deactivated")
    finally:
        changes.unpersist()
    return store.read(spark)


# Keyed state ---------------------------------------------------------------------------------------------------------


@query
def stream_net_pay_state(spark, sf):
    """Net pay out of one state per employee, over five parts of the log with a restart after each."""
    signals = SignalStream(spark, scratch_dir(spark, "signals"))
    net = BatchStore(scratch_dir(spark, "net-pay"))
    states = scratch_dir(spark, "states")

    def both_halves(log, checkpoint):
        jobs.run(log, lambda raw, batch_id: signals.process(raw.repartition("off"), batch_id), checkpoint).awaitTermination()
        return start_states(spark, signals, net, states, current_period=2)

    feed(spark, sf, (), both_halves)
    return net.table(spark, NET, NET_PAY_KEYS).drop("batch_id", "off")


# Indexed and bucketed tables -----------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf: str) -> SearchIndex:
    docs = documents(spark, sf)
    index = SearchIndex(scratch_dir(spark, "search-index"), docs.schema, buckets=16)
    index.build(docs)
    return index


@query
def search_indexed(spark, sf):
    """The search of ``search_simple``, through an index."""
    return _index(spark, sf).simple(spark, " Mary A ", "active", "1").select("employee_id", "first_name", "pay_type")


@query
def search_indexed_keyword(spark, sf):
    return _index(spark, sf).simple(spark, "r.1").select("employee_id", "email")


@query
def net_pay_bucketed(spark, sf):
    """Net pay from tables that were bucketed by employee, joined bucket by bucket."""
    return BucketedPayroll.write(payroll_of(spark, sf), spark, 8).net_pay(spark).drop("last_off")


# Ranges --------------------------------------------------------------------------------------------------------------

#: Bounds and rates of the brackets, before they are scaled by nation and year.
BASE_BRACKETS = [(0.0, 0.05), (2000.0, 0.10), (8000.0, 0.15), (20000.0, 0.20), (45000.0, 0.25), (80000.0, 0.30), (150000.0, 0.35)]


@query
def duty_brackets(spark, sf):
    """Line items by the bracket of their price, where brackets differ by the customer's nation and the year of the order."""
    orders = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = tables.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
    lines = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    base = F.array(*[F.struct(F.lit(i).alias("bracket"), F.lit(a).alias("a"), F.lit(b).cast("double").alias("b"), F.lit(r).alias("rate"))
                     for i, ((a, r), (b, _)) in enumerate(zip(BASE_BRACKETS, [*BASE_BRACKETS[1:], (None, 0)], strict=True))])
    factor = 1 + F.col("nation") / 50 + (F.col("year") - 1990) / 20
    points = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    points = points.select("l_orderkey", "l_linenumber", "l_extendedprice", "nation", "year")
    scaled = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("nation", "year").distinct().select("nation", "year", F.explode(base).alias("x"))
    brackets = scaled.select("nation", "year", "x.bracket", "x.rate", (F.col("x.a") * factor).alias("low"), (F.col("x.b") * factor).alias("high"))
    found = join_intervals(points, brackets, ["nation", "year"], "l_extendedprice", "low", "high", "l_orderkey")
    duty = F.floor((F.col("l_extendedprice") - F.col("low")) * F.col("rate") * 100 + 0.5).cast("long")
    return found.groupBy("nation", "year", "bracket").agg(F.count(F.lit(1)).alias("n"), F.sum(duty).alias("duty_cents"))


# Lookups, figures, versions ------------------------------------------------------------------------------------------


@query
def lookup_pruned(spark, sf):
    """Net pay of a few employees out of a table that is laid out for it."""
    path = scratch_dir(spark, "clustered")
    write_clustered(payroll_of(spark, sf).net_pay().drop("last_off"), path, "employee_id", 1000)
    asked = [f"{tables.EMPLOYEE_ID_STEM}{n:012d}" for n in (3, 17, 58, 99, 100_000)]
    return lookup(spark, path, "employee_id", asked)


@query
def search_page_observed(spark, sf):
    """The page of ``search_page``, whose hits are counted on the way."""
    docs = documents(spark, sf)
    matches = docs.filter(filters.compile_simple("", filters.searchable_fields(docs.schema)))
    return page_in_one_pass(matches).select("employee_id", "email", "total_hits")


@query
def stream_replay_stats(spark, sf):
    """Figures of a replay, observed in the micro-batches of the stream that reads it."""
    gone, runs = BatchStore(scratch_dir(spark, "gone")), []

    def start(log, checkpoint):
        named = observed(named_records(event_log.events_of(log)))
        ended = (F.col("event_type") == "employee.deactivated") & F.col("Id").isNotNull()
        run = jobs.run(named, lambda rows, batch_id: gone.write(rows.filter(ended).select("Id").distinct(), batch_id), checkpoint)
        runs.append(run)
        return run

    feed(spark, sf, (), start)
    ids = gone.read(spark, T.StructType([T.StructField("Id", T.StringType())])).select("Id").distinct()
    figures = [F.lit(v).cast("bigint").alias(k) for k, v in stream_figures(runs).items()]
    return ids.agg(F.count(F.lit(1)).alias("deactivated_employees")).select(*figures, "deactivated_employees")


@query
def rebuilt_projection(spark, sf):
    """The employee table, published first from half of the log and then from all of it, with the rows each run replaced."""
    path = scratch_dir(spark, "employees")
    events = tables.events(spark, sf, "employee").persist()
    try:
        project = lambda log: Payroll.of(log).employees()
        half = (events.agg(F.max("off")).first()[0] or 0) // 2
        first = jobs.rebuild(events.filter(F.col("off") <= half), project, path)
        second = jobs.rebuild(events, project, path)
    finally:
        events.unpersist()
    return Published(path).read(spark).select("*", F.lit(first).alias("dropped_first"), F.lit(second).alias("dropped_second"))


#: How long before and after its pay row an employee's record may be written for the notice to go out.
EARLIER, LATER = "8 DAYS", "36 HOURS"


@query
def stream_pay_notices(spark, sf):
    """Time entries that come within days of a record of their employee, before or after it, over five parts of the log."""
    store = BatchStore(scratch_dir(spark, "notices"))

    def start(rows, checkpoint):
        typed = rows.select(F.col("event_id").alias("off"), F.col("user_id").alias("employee_id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
        notices = pay_notices(typed.filter("event_type = 'click'").drop("event_type"), typed.filter("event_type = 'signup'"), EARLIER, LATER)
        return jobs.run(notices, lambda batch, batch_id: store.write(batch.select("off", "employee_id"), batch_id), checkpoint)

    feed(spark, sf, ("timeentry", "employee"), start, to_log=lambda rows, *entities: rows)
    found = store.read(spark, T.StructType([T.StructField("off", T.LongType()), T.StructField("employee_id", T.LongType())]))
    return found.select("off", "employee_id")


# Logs that bite ------------------------------------------------------------------------------------------------------


@query
def event_identity_forms(spark, sf):
    """Identity of events of both forms, in both spellings."""
    found = event_log.resolve_identity(tables.direct_events(spark, sf))
    return found.select("off", "employee_id", "event_id", "event_type", F.unix_micros("occurred_on").alias("occurred_us"))


@query
def landed_identity_forms(spark, sf):
    """The same out of a landed log, which files every record under the topic of its own type."""
    path = scratch_dir(spark, "landed-forms")
    log = tables.direct_events(spark, sf).select("off", F.to_json(F.struct("data")).alias("value"))
    event_log.land(log, path)
    stored = spark.read.schema(event_log.LANDED).parquet(path)
    # Both sides have a row per record, but with payloads pruned away a landed log is estimated far too small: no broadcast.
    topics = stored.select("off", "topic").hint("merge")
    found = event_log.resolve_identity(stored.drop("topic")).join(topics, "off")
    return found.select("off", "employee_id", "event_id", "event_type", F.unix_micros("occurred_on").alias("occurred_us"), "topic")


def _orders_payroll(spark: SparkSession, sf: str) -> Payroll:
    return Payroll.of(event_log.events_of(tables.orders_log(spark, sf)))


@query
def orders_last4_periods(spark, sf):
    """The four newest periods of employees who have worked in dozens."""
    newest = last_pay_periods(_orders_payroll(spark, sf).net_pay())
    return newest.select("employee_id", "pay_period_number", "total_hours_worked", "net_pay")


@query
def orders_search_page(spark, sf):
    """The first 200 of more documents, with the number of all hits."""
    docs = _orders_payroll(spark, sf).documents()
    hits = docs.filter(filters.compile_simple("buyer", filters.searchable_fields(docs.schema)))
    return filters.page(hits).select("employee_id", "email", F.size("pay_periods").cast("bigint").alias("periods"), "total_hits")
