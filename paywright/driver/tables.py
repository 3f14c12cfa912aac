"""A deterministic payroll event log derived from the ``events`` table.

Every row of ``events`` becomes one log record; ``event_id`` is the arrival order and ``k`` (from ``props``) picks the
details. Records are built as real JSON envelopes and parsed back by the library. ``SQL_LOG`` states the same mapping over
plain columns for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywright.sources.event_log import EMPTY_ID, events_of

# Fixed values of the mapping.
FIRST_NAMES = ["Ada", "Grace", "Mary Ann", "Edsger", "Barbara"]
STATES = ["CA", "NY", "TX", "fl", "WA", "ZZ", ""]
FILINGS = ["Single", "Married", "HeadOfHousehold", "marriedFilingJointly"]
DEDUCTION_CODES = [1, 2, 3, 4, 5, 99]
ENTITY_OF = {"click": "timeentry", "view": "timeentry", "signup": "employee", "purchase": "deduction", "error": "taxinfo"}
EMPLOYEE_ID_STEM = "00000000-0000-4000-8000-"
EVENT_ID_STEM = "00000000-0000-4000-9000-"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


#: Stated schemas spare a footer scan per read; tables not listed here are read with the schema their files carry.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def employee_key(number: Column) -> Column:
    return F.concat(F.lit(EMPLOYEE_ID_STEM), F.lpad(number.cast("string"), 12, "0"))


def pick(values: list, k: Column) -> Column:
    return F.element_at(F.lit(values), (k % len(values) + 1).cast("int"))


def kinds_of(*entities: str) -> list[str]:
    """Raw event kinds behind the named entities."""
    return [kind for kind, entity in ENTITY_OF.items() if entity in entities]


def spread(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of a table that lies in fewer files than there are cores, dealt to all of them before JSON is built.

    The branches of a query share that exchange, so a small table is scanned once however many they are. A table of many
    files is read as it lies: its columns are cheaper to scan once per branch than to shuffle whole.
    """
    few = len(rows.inputFiles()) < rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(key) if few else rows


def event_rows(spark: SparkSession, sf_dir: str, *entities: str) -> DataFrame:
    """The events table, restricted to the raw kinds behind ``entities`` by a filter that reaches the Parquet scan."""
    rows = table(spark, sf_dir, "events")
    if entities:
        rows = rows.filter(F.col("event_type").isin(kinds_of(*entities)))
    return spread(rows)


def _listed(values: list) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _sql_at(values: list) -> str:
    return f"element_at({_listed(values)}, CAST(k % {len(values)} + 1 AS INT))"


def _iso(expr: str) -> str:
    return f"date_format({expr}, \"{ISO_MICROS}\")"


_EMPLOYEE = f"concat('{EMPLOYEE_ID_STEM}', lpad(CAST(user_id AS STRING), 12, '0'))"

#: Per entity: its id, its event name, and the payload fields it adds, as Spark SQL over (off, k, user_id, value, ts).
_ENTITIES = {
    "timeentry": {
        "Id": "concat_ws('-', 'te', user_id, k)",
        "EventType": "CASE WHEN event_type = 'view' THEN 'timeentry.updated' WHEN k % 10 = 0 THEN 'timeentry.clockedin' "
        "ELSE 'timeentry.clockedout' END",
        "EmployeeId": _EMPLOYEE,
        "ClockIn": _iso("ts"),
        "ClockOut": f"CASE WHEN k % 10 <> 0 THEN {_iso('timestamp_seconds(unix_seconds(ts) + floor(value * 60))')} END",
        "HoursWorked": "CASE WHEN k % 10 = 0 THEN 0.0D ELSE value END",
    },
    "employee": {
        "Id": _EMPLOYEE,
        "EventType": "CASE WHEN k < 10 THEN 'employee.created' WHEN k < 94 THEN 'employee.updated' "
        "WHEN k < 97 THEN 'employee.activated' ELSE 'employee.deactivated' END",
        "FirstName": _sql_at(FIRST_NAMES),
        "LastName": "concat('Worker', user_id % 100)",
        "Email": f"concat(lower(replace({_sql_at(FIRST_NAMES)}, ' ', '')), '.', user_id, '@example.com')",
        "PayType": "1 + k % 2",
        "PayRate": "CASE WHEN k % 2 = 1 THEN value * 1000 ELSE value END",
        "PayPeriodHours": "CASE WHEN k % 7 <> 0 THEN 30 + k % 11 END",
        "HireDate": _iso("CAST(date_add(DATE '2020-01-01', k * 7) AS TIMESTAMP)"),
        "IsActive": "k < 97",
    },
    "deduction": {
        "Id": "concat_ws('-', 'ded', user_id, k % 20)",
        "EventType": "CASE WHEN k < 10 THEN 'deduction.created' WHEN k < 90 THEN 'deduction.updated' "
        "ELSE 'deduction.deactivated' END",
        "EmployeeId": _EMPLOYEE,
        "DeductionType": _sql_at(DEDUCTION_CODES),
        "Amount": "CASE WHEN k % 2 = 1 THEN k / 10.0D ELSE value END",
        "IsPercentage": "k % 2 = 1",
        "IsActive": "k % 9 <> 0 AND k < 90",
    },
    "taxinfo": {
        "Id": "concat_ws('-', 'tax', user_id)",
        "EventType": "CASE WHEN k < 10 THEN 'taxinfo.created' ELSE 'taxinfo.updated' END",
        "EmployeeId": _EMPLOYEE,
        "FederalFilingStatus": _sql_at(FILINGS),
        "FederalAllowances": "k % 5",
        "AdditionalFederalWithholding": "k % 50",
        "State": _sql_at(STATES),
        "AdditionalStateWithholding": "CASE WHEN k % 3 <> 0 THEN k % 5 END",
    },
}


def _member(name: str, entities: tuple[str, ...]) -> str:
    """A payload field: the value of whichever entity the row is, absent for entities without it."""
    whens = []
    for entity in entities:
        kinds = ", ".join(f"'{kind}'" for kind, owner in ENTITY_OF.items() if owner == entity)
        if name in _ENTITIES[entity]:
            whens.append(f"WHEN event_type IN ({kinds}) THEN {_ENTITIES[entity][name]}")
    return f"CASE {' '.join(whens)} END"


def to_log(rows: DataFrame, *entities: str) -> DataFrame:
    """Rows of ``events`` (batch or stream) to a raw log (off, value).

    Where the kinds of ``rows`` are known, naming their ``entities`` leaves out the payload fields of all others. Some
    records carry their payload as a JSON object, the others as JSON text.
    """
    wanted = entities or tuple(_ENTITIES)
    names = dict.fromkeys(name for e in wanted for name in _ENTITIES[e] if name not in ("Id", "EventType"))
    members = {
        "Id": _member("Id", wanted),
        "CreatedAt": _iso("ts"),
        "UpdatedAt": _iso("ts"),
        **{name: _member(name, wanted) for name in names},
        "DomainEvents": "array(named_struct("
        f"'EventId', concat('{EVENT_ID_STEM}', lpad(CAST(off AS STRING), 12, '0')), "
        f"'OccurredOn', {_iso('ts - make_dt_interval(k % 7)')}, 'EventType', {_member('EventType', wanted)}))",
    }
    payload = ", ".join(f"'{name}', {sql}" for name, sql in members.items())
    head = "'type', 'payroll.event', 'source', 'payroll-api'"
    as_object = """concat('{"type":"payroll.event","source":"payroll-api","data":', data, '}')"""
    return (
        rows.selectExpr(
            "event_id AS off", "CAST(get_json_object(props, '$.k') AS INT) AS k", "event_type", "user_id", "value",
            "CAST(ts AS TIMESTAMP) AS ts",
        )
        .selectExpr("off", "k", f"to_json(named_struct({payload})) AS data")
        .selectExpr("off", f"CASE WHEN k % 10 = 3 THEN {as_object} ELSE to_json(named_struct({head}, 'data', data)) END AS value")
    )


def raw_log(spark: SparkSession, sf_dir: str, *entities: str) -> DataFrame:
    return to_log(event_rows(spark, sf_dir, *entities), *entities)


def events(spark: SparkSession, sf_dir: str, *entities: str) -> DataFrame:
    """Log events (off, data)."""
    return events_of(raw_log(spark, sf_dir, *entities))


def redelivered(log: DataFrame) -> DataFrame:
    """The log as an at-least-once transport hands it over: some records arrive a second time, later."""
    first = log.withColumn("off", F.col("off") * 2)
    again = log.filter(F.col("off") % 10 == 0).withColumn("off", (F.col("off") + 40) * 2 + 1)
    return first.unionByName(again)


def _sql_pick(values: list, k: str) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{listed}], {k} % {len(values)} + 1)"


#: Common table expression ``log``: one typed row per event.
SQL_LOG = f"""
raw AS (
  SELECT event_id AS off, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS kind, user_id, value, ts,
         '{EMPLOYEE_ID_STEM}' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS emp
  FROM events
),
log AS (
  SELECT off, k, kind, user_id, value, ts, emp,
    CASE WHEN kind = 'click' AND k % 10 = 0 THEN 'timeentry.clockedin'
         WHEN kind = 'click' THEN 'timeentry.clockedout'
         WHEN kind = 'view' THEN 'timeentry.updated'
         WHEN kind = 'signup' AND k < 10 THEN 'employee.created'
         WHEN kind = 'signup' AND k < 94 THEN 'employee.updated'
         WHEN kind = 'signup' AND k < 97 THEN 'employee.activated'
         WHEN kind = 'signup' THEN 'employee.deactivated'
         WHEN kind = 'purchase' AND k < 10 THEN 'deduction.created'
         WHEN kind = 'purchase' AND k < 90 THEN 'deduction.updated'
         WHEN kind = 'purchase' THEN 'deduction.deactivated'
         WHEN k < 10 THEN 'taxinfo.created' ELSE 'taxinfo.updated' END AS event_type,
    CASE WHEN kind IN ('click', 'view') THEN 'te-' || user_id || '-' || k
         WHEN kind = 'purchase' THEN 'ded-' || user_id || '-' || (k % 20)
         WHEN kind = 'error' THEN 'tax-' || user_id ELSE emp END AS id,
    {_sql_pick(FIRST_NAMES, "k")} AS first_name,
    'Worker' || (user_id % 100) AS last_name,
    replace(lower({_sql_pick(FIRST_NAMES, "k")}), ' ', '') || '.' || user_id || '@example.com' AS email,
    CAST(1 + k % 2 AS VARCHAR) AS pay_type,
    CASE WHEN k % 2 = 1 THEN value * 1000 ELSE value END AS pay_rate,
    CASE WHEN k % 7 <> 0 THEN CAST(30 + k % 11 AS DOUBLE) END AS pay_period_hours,
    CAST(DATE '2020-01-01' + CAST(k * 7 AS INTEGER) AS TIMESTAMP) AS hire_date,
    CASE WHEN kind = 'signup' THEN k < 97 ELSE k % 9 <> 0 AND k < 90 END AS is_active,
    CASE WHEN k % 10 <> 0 THEN date_trunc('second', ts) + to_seconds(CAST(floor(value * 60) AS BIGINT)) END AS clock_out,
    CASE WHEN k % 10 = 0 THEN 0.0::DOUBLE ELSE value END AS hours_worked,
    {_sql_pick(FILINGS, "k")} AS filing,
    {_sql_pick(STATES, "k")} AS state,
    CAST(k % 50 AS DOUBLE) AS extra_federal,
    CASE WHEN k % 3 <> 0 THEN CAST(k % 5 AS DOUBLE) ELSE 0.0::DOUBLE END AS extra_state,
    {_sql_pick(DEDUCTION_CODES, "k")} AS deduction_type,
    CASE WHEN k % 2 = 1 THEN k / 10.0::DOUBLE ELSE value END AS amount,
    k % 2 = 1 AS is_percentage,
    '{EVENT_ID_STEM}' || lpad(CAST(off AS VARCHAR), 12, '0') AS event_id,
    ts - to_days(k % 7) AS occurred_on,
    CAST((CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 - 1704067200000) // 1209600000 AS BIGINT) AS per
  FROM raw
)"""


def direct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events (off, data) of which some are events themselves: with their own id and type, in either spelling.

    Of these some have an id that says nothing; their payload is read as an entity, which it is not.
    """
    rows = event_rows(spark, sf_dir).selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    entities = events_of(to_log(rows.filter("k % 10 <> 7").drop("k")))
    members = {
        "EventId": f"CASE WHEN k % 20 = 17 THEN '{EMPTY_ID}' ELSE concat('{EVENT_ID_STEM}', lpad(CAST(event_id AS STRING), 12, '0')) END",
        "EventType": "concat('projected.', event_type)",
        "EmployeeId": _EMPLOYEE,
        "OccurredOn": _iso("CAST(ts AS TIMESTAMP)"),
    }
    said = lambda low: "to_json(named_struct(" + ", ".join(f"'{n[0].lower() + n[1:] if low else n}', {sql}" for n, sql in members.items()) + "))"
    direct = rows.filter("k % 10 = 7").selectExpr("event_id AS off", f"CASE WHEN k % 3 = 0 THEN {said(True)} ELSE {said(False)} END AS data")
    return entities.unionByName(direct)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw log (off, value) out of ``orders``, whose days span years: each order is a shift of its customer, and sets the
    customer's rate for the pay period of that day. Dates are moved by 32 years, to where periods are counted from."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("CAST(o_orderdate + INTERVAL 32 YEARS AS TIMESTAMP)").alias("day"))
    employee = f"concat('{EMPLOYEE_ID_STEM}', lpad(CAST(o_custkey AS STRING), 12, '0'))"
    said = "to_json(named_struct('type', 'payroll.event', 'source', 'orders', 'data', to_json({data})))"
    domain = "array(named_struct('EventType', '{kind}'))"
    shift = (
        f"named_struct('Id', concat('o-', o_orderkey), 'EmployeeId', {employee}, 'ClockIn', {_iso('day')}, "
        f"'HoursWorked', CAST(1 + o_orderkey % 9 AS DOUBLE), 'DomainEvents', {domain.format(kind='timeentry.clockedout')})"
    )
    rate = (
        f"named_struct('Id', {employee}, 'FirstName', {_sql_at(FIRST_NAMES).replace('k %', 'o_custkey %')}, 'LastName', concat('Buyer', o_custkey), "
        "'Email', concat('buyer', o_custkey, '@example.com'), 'PayType', 1, 'PayRate', CAST(10 + o_orderkey % 31 AS DOUBLE), "
        f"'PayPeriodHours', 40, 'IsActive', o_custkey % 10 <> 3, 'UpdatedAt', {_iso('day')}, 'DomainEvents', {domain.format(kind='employee.updated')})"
    )
    both = f"array(named_struct('off', o_orderkey * 2, 'value', {said.format(data=shift)}), named_struct('off', o_orderkey * 2 + 1, 'value', {said.format(data=rate)}))"
    return spread(rows, "o_orderkey").selectExpr(f"explode({both}) AS x").select("x.*")
