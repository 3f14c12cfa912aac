"""SQL counterparts of the registered queries, over the plain columns of the driver's tables."""

from __future__ import annotations

from paywright.driver.tables import EMPLOYEE_ID_STEM, FILINGS, SQL_LOG, STATES, _sql_pick

# Fixed values, stated here once more so that a wrong one in the library shows.
SINGLE_BRACKETS = [
    (11600.0, 0.10), (47150.0, 0.12), (100525.0, 0.22), (191950.0, 0.24),
    (243725.0, 0.32), (609350.0, 0.35), (None, 0.37),
]
MARRIED_BRACKETS = [
    (23200.0, 0.10), (94300.0, 0.12), (201050.0, 0.22), (383900.0, 0.24),
    (487450.0, 0.32), (731200.0, 0.35), (None, 0.37),
]
STATE_RATES = {
    "AL": 0.0500, "AK": 0.0, "AZ": 0.0250, "AR": 0.0440, "CA": 0.0930, "CO": 0.0440, "CT": 0.0500, "DE": 0.0660,
    "FL": 0.0, "GA": 0.0549, "HI": 0.0725, "ID": 0.0580, "IL": 0.0495, "IN": 0.0305, "IA": 0.0570, "KS": 0.0570,
    "KY": 0.0400, "LA": 0.0425, "ME": 0.0715, "MD": 0.0575, "MA": 0.0500, "MI": 0.0425, "MN": 0.0985, "MS": 0.0500,
    "MO": 0.0480, "MT": 0.0675, "NE": 0.0664, "NV": 0.0, "NH": 0.0, "NJ": 0.1075, "NM": 0.0590, "NY": 0.0685,
    "NC": 0.0450, "ND": 0.0195, "OH": 0.0350, "OK": 0.0475, "OR": 0.0990, "PA": 0.0307, "RI": 0.0599, "SC": 0.0640,
    "SD": 0.0, "TN": 0.0, "TX": 0.0, "UT": 0.0465, "VT": 0.0875, "VA": 0.0575, "WA": 0.0, "WV": 0.0512,
    "WI": 0.0530, "WY": 0.0, "DC": 0.0895,
}
PAY_TYPES = {1: "Hourly", 2: "Salary"}
DEDUCTION_TYPES = {1: "Health", 2: "Dental", 3: "Vision", 4: "Retirement401k", 5: "LifeInsurance", 99: "Other"}

ORACLE: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _add(name: str, sql: str) -> None:
    ORACLE[name] = sql


def cents(x: str) -> str:
    return f"(floor(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"


def exact(x: str) -> str:
    return f"coalesce(CAST(SUM(CAST({x} AS DECIMAL(28,10))) AS DOUBLE), 0.0::DOUBLE)"


def bounds(per: str = "per") -> str:
    start = f"strftime(make_timestamp((1704067200000 + {per} * 1209600000) * 1000), '%Y-%m-%dT%H:%M:%S')"
    end = f"strftime(make_timestamp((1704067200000 + ({per} + 1) * 1209600000) * 1000), '%Y-%m-%dT%H:%M:%S')"
    return f"{start} AS pay_period_start, {end} AS pay_period_end"


def _federal_yearly(income: str, brackets) -> str:
    parts, lower = [], 0.0
    for upper, rate in brackets:
        top = income if upper is None else f"least({income}, {upper}::DOUBLE)"
        parts.append(f"greatest(0.0::DOUBLE, {top} - {lower}::DOUBLE) * {rate}::DOUBLE")
        lower = upper
    return "(" + " + ".join(parts) + ")"


def federal(gross: str, filing: str) -> str:
    income = f"({gross} * 26.0::DOUBLE)"
    married = _federal_yearly(income, MARRIED_BRACKETS)
    single = _federal_yearly(income, SINGLE_BRACKETS)
    yearly = f"(CASE WHEN lower({filing}) IN ('married', 'marriedfilingjointly') THEN {married} ELSE {single} END)"
    return cents(f"{yearly} / 26.0::DOUBLE")


def rate_of(state: str) -> str:
    whens = " ".join(f"WHEN '{code}' THEN {rate}::DOUBLE" for code, rate in STATE_RATES.items())
    return f"(CASE upper({state}) {whens} ELSE 0.0::DOUBLE END)"


def state_tax(gross: str, rate: str) -> str:
    return cents(f"{gross} * 26.0::DOUBLE * {rate} / 26.0::DOUBLE")


# Shared pieces. Latest values use arg_max, which skips NULL values as "latest present" does.
GROSS_EVENTS = """
gpe AS (
  SELECT off, emp, per, CASE WHEN kind = 'signup' THEN '__PAY_RATE__' ELSE id END AS entry,
    CASE WHEN kind = 'signup' THEN 0.0::DOUBLE ELSE hours_worked END AS hours,
    CASE WHEN kind = 'signup' THEN pay_rate END AS rate, CASE WHEN kind = 'signup' THEN pay_type END AS type,
    CASE WHEN kind = 'signup' THEN pay_period_hours END AS salary_hours
  FROM log WHERE event_type IN ('employee.created', 'employee.updated', 'timeentry.clockedout', 'timeentry.updated')
)"""
GROSS = f"""
entry_hours AS (SELECT emp, per, {exact('h')} AS hours FROM (SELECT emp, per, entry, arg_max(hours, off) AS h FROM gpe GROUP BY ALL) GROUP BY emp, per),
rates AS (
  SELECT emp, per, arg_max(rate, off) AS pay_rate, arg_max(type, off) AS pay_type, arg_max(salary_hours, off) AS pay_period_hours,
    COUNT(*) AS event_count, MAX(off) AS last_off
  FROM gpe GROUP BY emp, per
),
gross AS (
  SELECT r.*, CASE WHEN pay_type = '2' THEN pay_period_hours ELSE hours END AS total_hours_worked,
    CASE WHEN pay_type = '2' THEN pay_rate / 2080.0::DOUBLE ELSE pay_rate END AS effective_hourly_rate
  FROM rates r JOIN entry_hours USING (emp, per)
),
gross_pay AS (SELECT *, effective_hourly_rate * total_hours_worked AS gross FROM gross)"""
DEDUCTIONS = f"""
ded AS (
  SELECT off, emp, id, event_type <> 'deduction.deactivated' AS live,
    event_type <> 'deduction.deactivated' AND is_active AS active, amount, is_percentage
  FROM log WHERE kind = 'purchase'
),
ded_state AS (
  SELECT emp, id, coalesce(arg_max(amount, off) FILTER (live), 0.0::DOUBLE) AS amount,
    coalesce(arg_max(is_percentage, off) FILTER (live), false) AS pct, arg_max(active, off) AS active
  FROM ded GROUP BY emp, id
),
ded_totals AS (
  SELECT emp, {exact('CASE WHEN active AND NOT pct THEN amount END')} AS fixed_total,
    {exact('CASE WHEN active AND pct THEN amount / 100.0::DOUBLE END')} AS percent_share
  FROM ded_state GROUP BY emp
)"""
TAX = """
tax_latest AS (
  SELECT emp, arg_max(filing, off) AS filing, arg_max(state, off) AS state, arg_max(extra_federal, off) AS xf,
    arg_max(extra_state, off) AS xs
  FROM log WHERE kind = 'error' GROUP BY emp
)"""
GONE = "gone AS (SELECT DISTINCT emp FROM log WHERE event_type = 'employee.deactivated')"


def breakdown(name: str, source: str) -> str:
    """CTE ``name`` over a source with gross columns, filing, state, xf, xs, fixed_total, percent_share."""
    return f"""
{name}_parts AS (
  SELECT emp, per, last_off, coalesce(gross, 0.0::DOUBLE) AS g, coalesce(pay_rate, 0.0::DOUBLE) AS pay_rate,
    coalesce(pay_type, '1') AS pay_type, coalesce(total_hours_worked, 0.0::DOUBLE) AS total_hours_worked,
    CASE WHEN filing IS NULL THEN 0.0::DOUBLE ELSE {federal('coalesce(gross, 0.0::DOUBLE)', 'filing')} END AS ft,
    CASE WHEN filing IS NULL THEN 0.0::DOUBLE ELSE {state_tax('coalesce(gross, 0.0::DOUBLE)', rate_of('state'))} END AS st,
    coalesce(xf, 0.0::DOUBLE) AS xf, coalesce(xs, 0.0::DOUBLE) AS xs, coalesce(fixed_total, 0.0::DOUBLE) AS fd,
    coalesce(percent_share, 0.0::DOUBLE) * coalesce(gross, 0.0::DOUBLE) AS pd
  FROM {source}
),
{name} AS (
  SELECT emp AS employee_id, per AS pay_period_number, {cents('g')} AS gross_pay, {cents('ft')} AS federal_tax,
    {cents('st')} AS state_tax, {cents('xf')} AS additional_federal_withholding,
    {cents('xs')} AS additional_state_withholding, {cents('ft + st + xf + xs')} AS total_tax,
    {cents('fd')} AS total_fixed_deductions, {cents('pd')} AS total_percent_deductions,
    {cents('fd + pd')} AS total_deductions, {cents('g - (ft + st + xf + xs) - (fd + pd)')} AS net_pay,
    pay_rate, pay_type, total_hours_worked, {bounds()}, last_off
  FROM {name}_parts
)"""


NET_JOIN = "(SELECT * FROM gross_pay LEFT JOIN tax_latest USING (emp) LEFT JOIN ded_totals USING (emp))"
LIVE_JOIN = "(SELECT * FROM gross_pay LEFT JOIN tax_latest USING (emp) LEFT JOIN ded_totals USING (emp) WHERE emp NOT IN (SELECT emp FROM gone))"
NET = [SQL_LOG, GROSS_EVENTS, GROSS, DEDUCTIONS, TAX, GONE, breakdown("net", LIVE_JOIN)]
INFO = """
info AS (
  SELECT emp AS employee_id, arg_max(first_name, off) AS first_name, arg_max(last_name, off) AS last_name,
    arg_max(email, off) AS email, arg_max(pay_type, off) AS pay_type, arg_max(pay_rate, off) AS pay_rate,
    arg_max(pay_period_hours, off) AS pay_period_hours, arg_max(is_active, off) AS is_active,
    arg_max(hire_date, off) AS hire_date, arg_max(event_type, off) AS last_event_type
  FROM log WHERE kind = 'signup' GROUP BY emp
)"""
_ISO_DATE = "strftime(hire_date, '%Y-%m-%dT%H:%M:%S') || '.000000Z'"
DOCS = f"""
docs AS (
  SELECT employee_id, first_name, last_name, email, pay_type, pay_rate, coalesce(pay_period_hours, 0.0::DOUBLE) AS pay_period_hours,
    is_active, hire_date
  FROM info
),
periods AS (
  SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY pay_period_number DESC) AS rn FROM net QUALIFY rn <= 4
)"""
SEARCH = [*NET, INFO, DOCS]


def latest_entity(name: str, kinds: str, columns: str) -> str:
    return f"""
{name} AS (
  SELECT {columns} FROM log WHERE kind IN ({kinds}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY off DESC) = 1
)"""


EMPLOYEES = latest_entity("employees", "'signup'", "*")
ENTRIES = latest_entity("entries", "'click', 'view'", "*")
DED_LIST = latest_entity("ded_list", "'purchase'", "*")

# Sources and projections ---------------------------------------------------------------------------------------------

_ts = "CAST(epoch(date_trunc('second', ts)) AS BIGINT)"
_add("raw_entities", _with(SQL_LOG, EMPLOYEES, ENTRIES, DED_LIST, latest_entity("tax_list", "'error'", "*")) + f"""
SELECT 'employee' AS entity, id, emp AS employee_id, round(pay_rate, 2) AS amount, is_active, {_ts} AS updated FROM employees
UNION ALL SELECT 'timeentry', id, emp, hours_worked, clock_out IS NULL, {_ts} FROM entries
UNION ALL SELECT 'taxinfo', id, emp, extra_federal, state <> '', {_ts} FROM tax_list
UNION ALL SELECT 'deduction', id, emp, amount, is_active, {_ts} FROM ded_list""")
_add("demux_counts", _with(SQL_LOG) + """
SELECT CASE WHEN event_type = 'employee.deactivated' THEN 'deactivated' WHEN kind = 'error' THEN 'tax'
  WHEN kind = 'purchase' THEN 'deduction' ELSE 'ignored' END AS branch, COUNT(*) AS n FROM log GROUP BY 1""")
_add("event_topic_routing", _with(SQL_LOG) + """
SELECT split_part(event_type, '.', 1) || '-events' AS topic, event_type, COUNT(*) AS n FROM log GROUP BY ALL""")
_add("event_identity", _with(SQL_LOG) + """
SELECT off, CASE WHEN kind = 'signup' THEN emp ELSE id END AS employee_id, event_id, event_type, epoch_us(occurred_on) AS occurred_us FROM log""")
_add("employee_info", _with(SQL_LOG, INFO) + f"""
SELECT employee_id, first_name, last_name, email, pay_type, pay_rate, pay_period_hours,
  CAST(is_active AS VARCHAR) AS is_active, {_ISO_DATE} AS hire_date, last_event_type FROM info""")
_add("time_entry_events", _with(SQL_LOG) + """
SELECT off, id AS time_entry_id, emp AS employee_id, hours_worked, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS clock_in_time,
  strftime(clock_out, '%Y-%m-%dT%H:%M:%S.%fZ') AS clock_out_time, per AS pay_period_number
FROM log WHERE event_type IN ('timeentry.clockedout', 'timeentry.updated')""")
_add("gross_pay_events", _with(SQL_LOG, GROSS_EVENTS) + """
SELECT off, emp AS employee_id, entry AS time_entry_id, hours AS hours_worked, rate AS pay_rate, type AS pay_type,
  salary_hours AS pay_period_hours, per AS pay_period_number FROM gpe""")
_add("period_bounds", _with(SQL_LOG) + f"""
SELECT per AS pay_period_number, CAST(1704067200 + per * 1209600 AS BIGINT) AS window_start, n, {bounds()}
FROM (SELECT per, COUNT(*) AS n FROM log GROUP BY per)""")
_add("hours_worked", """
WITH spans AS (
  SELECT l_orderkey, l_linenumber, o_orderdate AS clock_in, l_shipdate + to_seconds(l_orderkey % 3600) AS clock_out
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
micros AS (SELECT *, epoch_us(clock_out) - epoch_us(clock_in) AS us FROM spans),
parts AS (SELECT *, us // 36000000 AS whole, us % 36000000 AS rest FROM micros)
SELECT l_orderkey, l_linenumber, clock_out <= clock_in AS rejected,
  CASE WHEN clock_out <= clock_in THEN NULL
       WHEN rest > 18000000 OR (rest = 18000000 AND whole % 2 = 1) THEN (whole + 1) / 100.0::DOUBLE
       ELSE whole / 100.0::DOUBLE END AS hours_worked
FROM parts""")
_add("key_parse", f"""
SELECT event_id, '{EMPLOYEE_ID_STEM}' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS employee_id FROM events""")

# Pay -----------------------------------------------------------------------------------------------------------------

_add("hours_by_period", _with(SQL_LOG) + f"""
, te AS (SELECT * FROM log WHERE event_type IN ('timeentry.clockedout', 'timeentry.updated')),
last_value AS (SELECT emp, per, id, arg_max(hours_worked, off) AS h, COUNT(*) AS n FROM te GROUP BY ALL)
SELECT emp AS employee_id, per AS pay_period_number, {exact('h')} AS total_hours_worked, CAST(SUM(n) AS BIGINT) AS event_count, {bounds()}
FROM last_value GROUP BY emp, per""")
_add("gross_pay_by_period", _with(SQL_LOG, GROSS_EVENTS, GROSS) + f"""
SELECT emp AS employee_id, per AS pay_period_number, pay_rate, pay_type, pay_period_hours, total_hours_worked,
  effective_hourly_rate, gross AS gross_pay, event_count, {bounds()} FROM gross_pay""")
_add("deduction_state", _with(SQL_LOG, DEDUCTIONS) + """
SELECT emp AS employee_id, id AS deduction_id, amount, pct AS is_percentage, active AS is_active FROM ded_state""")
_add("deduction_totals", _with(SQL_LOG, DEDUCTIONS) + "SELECT emp AS employee_id, fixed_total, percent_share FROM ded_totals")
_add("active_deductions", _with(SQL_LOG, DED_LIST) + """
SELECT emp AS employee_id, COUNT(*) FILTER (is_active) AS active_deductions FROM ded_list GROUP BY emp""")
_add("tax_state", _with(SQL_LOG, TAX) + """
SELECT emp AS employee_id, filing AS federal_filing_status, state, xf AS additional_federal_withholding,
  xs AS additional_state_withholding FROM tax_latest""")
_INCOMES = f"""
incomes AS (
  SELECT o_orderkey, o_totalprice / 20 AS gross, {_sql_pick(FILINGS, 'o_orderkey')} AS filing,
    {_sql_pick(STATES, 'o_orderkey')} AS state
  FROM orders
)"""
_add("federal_tax", _with(_INCOMES) + f"SELECT o_orderkey, {federal('gross', 'filing')} AS federal_tax FROM incomes")
_add("federal_tax_lookup", _with(_INCOMES) + f"SELECT o_orderkey, {federal('gross', 'filing')} AS federal_tax FROM incomes")
_add("state_tax", _with(_INCOMES) + f"""
SELECT o_orderkey, {rate_of('state')} AS state_rate, {state_tax('gross', rate_of('state'))} AS state_tax FROM incomes""")
_add("net_pay", _with(*NET) + "SELECT * EXCLUDE (last_off) FROM net")
_SEEN = "CASE WHEN per = 2 THEN 9223372036854775807 ELSE last_off END"
def asof(live: str) -> str:
    """As-of settings of the gross rows that ``live`` (a condition) leaves."""
    return f"""
probes AS (SELECT *, {_SEEN} AS seen_at FROM gross_pay WHERE {live}),
asof_tax AS (
  SELECT p.emp, p.per, arg_max(filing, l.off) AS filing, arg_max(state, l.off) AS state, arg_max(extra_federal, l.off) AS xf,
    arg_max(extra_state, l.off) AS xs
  FROM probes p JOIN log l ON l.emp = p.emp AND l.kind = 'error' AND l.off <= p.seen_at GROUP BY ALL
),
asof_ded AS (
  SELECT p.emp, p.per, id, coalesce(arg_max(amount, d.off) FILTER (live), 0.0::DOUBLE) AS amount,
    coalesce(arg_max(is_percentage, d.off) FILTER (live), false) AS pct, arg_max(active, d.off) AS active
  FROM probes p JOIN ded d ON d.emp = p.emp AND d.off <= p.seen_at GROUP BY ALL
),
asof_totals AS (
  SELECT emp, per, {exact('CASE WHEN active AND NOT pct THEN amount END')} AS fixed_total,
    {exact('CASE WHEN active AND pct THEN amount / 100.0::DOUBLE END')} AS percent_share
  FROM asof_ded GROUP BY emp, per
)"""


_ASOF = asof("emp NOT IN (SELECT emp FROM gone)")
_add("net_pay_asof", _with(
    SQL_LOG, GROSS_EVENTS, GROSS, DEDUCTIONS, GONE, _ASOF,
    breakdown("net", "(SELECT * FROM probes LEFT JOIN asof_tax USING (emp, per) LEFT JOIN asof_totals USING (emp, per))"),
) + "SELECT * EXCLUDE (last_off) FROM net")
_add("current_period_recompute", _with(
    SQL_LOG, GROSS_EVENTS, GROSS, DEDUCTIONS, TAX, breakdown("net", NET_JOIN)
) + """
SELECT * EXCLUDE (last_off) FROM net
WHERE pay_period_number = 2 AND employee_id IN (SELECT emp FROM log WHERE kind IN ('error', 'purchase'))""")
_add("net_pay_lookup", _with(*NET) + f"""
, asked AS (SELECT DISTINCT '{EMPLOYEE_ID_STEM}' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS employee_id,
  CAST(dayofyear(o_orderdate) % 4 AS BIGINT) AS pay_period_number FROM orders)
SELECT employee_id, pay_period_number, gross_pay, net_pay FROM net JOIN asked USING (employee_id, pay_period_number)""")
_add("tombstones", _with(SQL_LOG, GROSS_EVENTS, GONE) + """
SELECT DISTINCT '{"EMPLOYEE_ID":"' || emp || '","PAY_PERIOD_NUMBER":' || per || '}' AS key, CAST(NULL AS VARCHAR) AS value
FROM gpe WHERE emp IN (SELECT emp FROM gone)""")
_add("compacted_table", _with(SQL_LOG) + """
SELECT off, id AS time_entry_id, emp AS employee_id, hours_worked, per AS pay_period_number
FROM (SELECT * FROM log WHERE event_type IN ('timeentry.clockedout', 'timeentry.updated')
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY off DESC) = 1)
WHERE clock_out IS NOT NULL""")
_add("upsert_table", _with(SQL_LOG) + """
, te AS (SELECT * FROM log WHERE event_type IN ('timeentry.clockedout', 'timeentry.updated')),
target AS (SELECT id, arg_max(hours_worked, off) AS h FROM te WHERE per < 1 AND clock_out IS NOT NULL GROUP BY id),
changes AS (SELECT id, hours_worked AS h, clock_out IS NULL AS gone FROM te WHERE per >= 1
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY off DESC) = 1)
SELECT id AS time_entry_id, h AS hours_worked FROM target WHERE id NOT IN (SELECT id FROM changes)
UNION ALL SELECT id, h FROM changes WHERE NOT gone""")
_add("deactivated_employees", _with(SQL_LOG, GONE) + "SELECT emp AS employee_id FROM gone")
_add("replay_stats", _with(SQL_LOG) + """
SELECT COUNT(*) AS total_records, COUNT(*) FILTER (event_type = 'employee.created') AS created,
  COUNT(*) FILTER (event_type = 'employee.deactivated') AS deactivated,
  COUNT(DISTINCT CASE WHEN event_type = 'employee.deactivated' THEN emp END) AS deactivated_employees FROM log""")
_add("directory_stats", _with(SQL_LOG, EMPLOYEES) + """
SELECT COUNT(*) AS total, COUNT(*) FILTER (is_active) AS active, COUNT(*) FILTER (pay_type = '1') AS hourly,
  COUNT(*) FILTER (pay_type = '2') AS salaried FROM employees""")


def _label(code: str, table: dict[int, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " END"


_add("directory_labels", _with(SQL_LOG, EMPLOYEES, DED_LIST) + f"""
SELECT code_set, label, COUNT(*) AS n FROM (
  SELECT 'pay_type' AS code_set, {_label('CAST(pay_type AS INTEGER)', PAY_TYPES)} AS label FROM employees
  UNION ALL SELECT 'deduction_type', {_label('deduction_type', DEDUCTION_TYPES)} FROM ded_list
) GROUP BY ALL""")
_add("total_hours", _with(SQL_LOG, ENTRIES) + """
SELECT emp AS employee_id, CAST(SUM(CAST(hours_worked AS DECIMAL(18,2))) AS DOUBLE) AS total_hours FROM entries GROUP BY emp""")
_add("clocked_in", _with(SQL_LOG, ENTRIES) + """
SELECT emp AS employee_id, bool_or(clock_out IS NULL) AS clocked_in FROM entries GROUP BY emp""")

# Read model ----------------------------------------------------------------------------------------------------------

ACCEPTED = """
deliveries AS (SELECT * REPLACE (off * 2 AS off) FROM log WHERE kind = 'signup'
  UNION ALL SELECT * REPLACE ((off + 40) * 2 + 1 AS off) FROM log WHERE kind = 'signup' AND off % 10 = 0),
accepted AS (
  SELECT * FROM deliveries QUALIFY occurred_on > coalesce(
    MAX(occurred_on) OVER (PARTITION BY emp ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '0001-01-01')
)"""
RECORD = """
record AS (
  SELECT emp,
    coalesce(arg_max(first_name, off) FILTER (f), '') AS first_name, coalesce(arg_max(last_name, off) FILTER (f), '') AS last_name,
    coalesce(arg_max(email, off) FILTER (f), '') AS email, coalesce(arg_max(pay_type, off) FILTER (f), '') AS pay_type,
    round(arg_max(pay_rate, off) FILTER (f), 2) AS pay_rate,
    coalesce(arg_max(coalesce(pay_period_hours, 40.0::DOUBLE), off) FILTER (f), 40.0::DOUBLE) AS pay_period_hours,
    arg_max(CASE event_type WHEN 'employee.activated' THEN true WHEN 'employee.deactivated' THEN false ELSE is_active END, off) AS is_active,
    arg_max(event_type, off) AS last_event_type, arg_max(event_id, off) AS last_event_id, arg_max(occurred_on, off) AS last_event,
    arg_min(occurred_on, off) AS created, MIN(off) AS first_off,
    coalesce(MAX(off) FILTER (event_type = 'employee.deactivated'), -1) AS reset_off
  FROM (SELECT *, event_type IN ('employee.created', 'employee.updated') AS f FROM accepted) GROUP BY emp
)"""
# A row is shown as of the event that caused it: its own last one, in the current period (2) also a later setting.
CAUSED = """(
  SELECT * REPLACE (CASE WHEN per = 2 THEN greatest(last_off, coalesce(moved, last_off)) ELSE last_off END AS last_off)
  FROM probes LEFT JOIN asof_tax USING (emp, per) LEFT JOIN asof_totals USING (emp, per)
  LEFT JOIN (SELECT emp, MAX(off) AS moved FROM log WHERE kind IN ('error', 'purchase') GROUP BY emp) USING (emp))"""
PAY_ROWS = [GROSS_EVENTS, GROSS, DEDUCTIONS, asof("true"), breakdown("paid", CAUSED)]
SHOWN = """
shown AS (
  SELECT p.* REPLACE (last_off * 2 AS last_off) FROM paid p JOIN record r ON p.employee_id = r.emp
  WHERE p.last_off * 2 > reset_off AND p.last_off * 2 >= first_off
  QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY pay_period_number DESC, last_off DESC) = 1
)"""
_add("accepted_events", _with(SQL_LOG, ACCEPTED) + """
SELECT off, emp AS employee_id, event_id, event_type, epoch_us(occurred_on) AS occurred_us FROM accepted""")
_add("employee_record", _with(SQL_LOG, ACCEPTED, RECORD) + """
SELECT emp AS employee_id, first_name, last_name, email, pay_type, pay_rate, pay_period_hours, is_active, last_event_type,
  last_event_id, epoch_us(last_event) AS last_event_us, epoch_us(created) AS created_us FROM record""")
_add("pay_attributes", _with(SQL_LOG, ACCEPTED, RECORD, *PAY_ROWS, SHOWN) + """
SELECT employee_id, pay_period_number, gross_pay, total_tax, total_deductions, net_pay FROM shown""")
_add("employees_with_pay", _with(SQL_LOG, ACCEPTED, RECORD, *PAY_ROWS, SHOWN) + """
SELECT emp AS employee_id, email, is_active, pay_period_number, net_pay FROM record LEFT JOIN shown ON emp = employee_id""")
_add("filter_generic", _with(SQL_LOG, ACCEPTED, RECORD, *PAY_ROWS, SHOWN) + """
SELECT emp AS employee_id, r.first_name, r.last_name FROM record r LEFT JOIN shown s ON r.emp = s.employee_id
WHERE ((lower(r.first_name) LIKE 'mary%' AND r.is_active) OR (s.net_pay > 3000 AND lower(r.email) NOT LIKE '%grace%')
  OR lower(r.last_name) IN ('worker7', 'worker42', 'worker99')) AND NOT coalesce(r.pay_rate < 20, false)""")
FEED = """
resets AS (SELECT emp, off FROM accepted WHERE event_type = 'employee.deactivated'),
known_pay AS (
  SELECT p.employee_id, p.pay_period_number AS per, p.last_off * 2 AS off,
    (SELECT COUNT(*) FROM resets d WHERE d.emp = p.employee_id AND d.off <= p.last_off * 2) AS segment
  FROM paid p JOIN record r ON p.employee_id = r.emp WHERE p.last_off * 2 >= first_off
),
feed AS (
  SELECT off, emp AS employee_id, split_part(event_type, '.', 2) AS change_type FROM accepted
  UNION ALL
  SELECT off, employee_id, 'payUpdated' FROM (
    SELECT *, MAX(per) OVER (PARTITION BY employee_id, segment ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM known_pay) WHERE top IS NULL OR per >= top
)"""
_add("change_feed", _with(SQL_LOG, ACCEPTED, RECORD, *PAY_ROWS, FEED) + "SELECT off, employee_id, change_type FROM feed")
_add("change_feed_newest", _with(SQL_LOG, ACCEPTED, RECORD, *PAY_ROWS, FEED) + """
SELECT off, employee_id, change_type FROM feed ORDER BY off DESC, employee_id, change_type LIMIT 50""")
_add("cascade_deactivation", _with(SQL_LOG, *PAY_ROWS, GONE) + """
SELECT employee_id, pay_period_number, net_pay FROM paid WHERE employee_id NOT IN (SELECT emp FROM gone)""")

# Search --------------------------------------------------------------------------------------------------------------

_add("last4_pay_periods", _with(*NET) + """
SELECT employee_id, pay_period_number, net_pay FROM net
QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY pay_period_number DESC) <= 2""")
_add("search_documents", _with(*SEARCH) + f"""
SELECT d.employee_id, first_name, last_name, email, d.pay_type, coalesce(d.pay_rate, 0.0::DOUBLE) AS pay_rate, pay_period_hours,
  {_ISO_DATE} AS hire_date, pay_period_number, net_pay, pay_period_start
FROM docs d LEFT JOIN periods p ON d.employee_id = p.employee_id WHERE is_active""")
_add("search_hits_projection", _with(*SEARCH) + """
SELECT d.employee_id AS id, first_name AS "firstName", CAST(d.pay_type AS INTEGER) AS "payType", d.pay_rate AS "payRate",
  is_active AS "isActive", COUNT(p.pay_period_number) AS periods, round(coalesce(SUM(p.net_pay), 0.0::DOUBLE), 2) AS "netPaySum"
FROM docs d LEFT JOIN periods p ON d.employee_id = p.employee_id GROUP BY ALL""")
_add("search_simple", _with(*SEARCH) + """
SELECT employee_id, first_name, pay_type FROM docs
WHERE (regexp_matches(lower(first_name), '(^|\\W)mary\\W+a') OR regexp_matches(lower(last_name), '(^|\\W)mary\\W+a')
  OR contains(email, 'mary a')) AND is_active AND pay_type = '1'""")
_add("search_simple_keyword", _with(*SEARCH) + """
SELECT employee_id, email FROM docs
WHERE contains(email, 'r.1') OR regexp_matches(lower(first_name), '(^|\\W)r\\W+1') OR regexp_matches(lower(last_name), '(^|\\W)r\\W+1')""")
_add("search_page", _with(*SEARCH) + """
SELECT employee_id, email, (SELECT COUNT(*) FROM docs) AS total_hits FROM docs ORDER BY employee_id LIMIT 200""")
_add("search_advanced", _with(*SEARCH) + f"""
SELECT employee_id, first_name, {_ISO_DATE} AS hire_date FROM docs
WHERE (first_name LIKE 'Gra%' AND pay_rate >= 30.5 AND is_active)
  OR (hire_date >= DATE '2020-06-01' AND hire_date < DATE '2021-01-01' AND coalesce(pay_type <> '2', true) AND contains(email, 'ada'))
  OR (last_name = 'Worker17' AND hire_date >= DATE '2020-03-05')""")
_add("search_nested", _with(*SEARCH) + """
, has AS (SELECT employee_id, bool_or(net_pay > 1000) AS a, bool_or(pay_type = '1') AS b, bool_or(pay_period_number <> 0) AS c,
  bool_or(pay_period_start >= '2024-01-11') AS d FROM periods GROUP BY employee_id)
SELECT employee_id, docs.pay_type FROM docs JOIN has USING (employee_id) WHERE a AND b AND c AND d""")

# Lookups, merges, checks ---------------------------------------------------------------------------------------------

_emp_of = lambda c: f"'{EMPLOYEE_ID_STEM}' || lpad(CAST({c} AS VARCHAR), 12, '0')"
_add("employee_lookup", _with(SQL_LOG, EMPLOYEES) + f"""
SELECT id, first_name, last_name, CAST(pay_type AS INTEGER) AS pay_type FROM employees
WHERE id IN (SELECT {_emp_of('c_custkey')} FROM customer WHERE c_acctbal > 0)""")
_add("time_entries_sorted", _with(SQL_LOG, ENTRIES) + """
SELECT emp AS employee_id, id, epoch_us(ts) AS clock_in_us FROM entries ORDER BY emp, ts DESC, id""")
_add("open_entry", _with(SQL_LOG, ENTRIES) + """
SELECT emp AS employee_id, id, epoch_us(ts) AS clock_in_us FROM entries WHERE clock_out IS NULL
QUALIFY row_number() OVER (PARTITION BY emp ORDER BY ts, id) = 1""")
_add("audit_history", _with(SQL_LOG) + """
SELECT off, emp AS employee_id, event_type, pay_rate, lag(pay_rate) OVER (PARTITION BY emp ORDER BY off) AS previous_rate
FROM log WHERE kind = 'signup'""")
_add("fallback_read", _with(SQL_LOG, EMPLOYEES) + f"""
SELECT coalesce(e.id, c.id) AS id, CASE WHEN e.id IS NOT NULL THEN e.first_name || ' ' || e.last_name ELSE c.c_name END AS name,
  CASE WHEN e.id IS NOT NULL THEN round(e.pay_rate, 2) ELSE c.c_acctbal END AS amount
FROM employees e FULL JOIN (SELECT *, {_emp_of('c_custkey')} AS id FROM customer) c ON e.id = c.id""")
_add("merge_snapshot", _with(SQL_LOG, EMPLOYEES) + f"""
SELECT coalesce(e.id, c.id) AS id, coalesce(e.first_name || ' ' || e.last_name, c.c_name) AS name, c_mktsegment AS segment,
  coalesce(round(e.pay_rate, 2), c.c_acctbal) AS pay_rate
FROM employees e FULL JOIN (SELECT *, {_emp_of('c_custkey')} AS id FROM customer) c ON e.id = c.id""")
_add("union_outputs", _with(*NET, INFO) + """
, gone_keys AS (SELECT DISTINCT emp, per FROM gross_pay WHERE emp IN (SELECT emp FROM gone)),
records AS (
  SELECT 'employee_info' AS topic, '"' || employee_id || '"' AS key, 1 AS live FROM info
  UNION ALL SELECT 'net_pay', '{"EMPLOYEE_ID":"' || employee_id || '","PAY_PERIOD_NUMBER":' || pay_period_number || '}', 1 FROM net
  UNION ALL SELECT 'net_pay', '{"EMPLOYEE_ID":"' || emp || '","PAY_PERIOD_NUMBER":' || per || '}', 0 FROM gone_keys
)
SELECT topic, COUNT(*) AS records, CAST(SUM(live) AS BIGINT) AS live, CAST(SUM(length(key)) AS BIGINT) AS key_chars FROM records GROUP BY topic""")
_add("ref_check", _with(SQL_LOG) + """
SELECT off, l.emp AS employee_id, coalesce(off > since, false) AS accepted
FROM log l LEFT JOIN (SELECT emp, MIN(off) AS since FROM log WHERE event_type = 'employee.created' GROUP BY emp) c ON c.emp = l.emp
WHERE kind = 'purchase'""")
_add("target_check", _with(SQL_LOG) + """
SELECT off, l.id AS deduction_id, coalesce(off > since, false) AS accepted
FROM log l LEFT JOIN (SELECT id, MIN(off) AS since FROM log WHERE event_type = 'deduction.created' GROUP BY id) c ON c.id = l.id
WHERE kind = 'purchase' AND event_type <> 'deduction.created'""")
_add("uniqueness_check", _with(SQL_LOG) + """
, clock AS (
  SELECT off, emp, event_type = 'timeentry.clockedin' AS is_in,
    lag(event_type = 'timeentry.clockedin') OVER (PARTITION BY emp ORDER BY off) AS was_in
  FROM log WHERE kind IN ('click', 'view')
)
SELECT off, emp AS employee_id, off = MIN(off) OVER (PARTITION BY emp) AS accepted, 'tax' AS rule FROM log WHERE kind = 'error'
UNION ALL SELECT off, emp, CASE WHEN is_in THEN NOT coalesce(was_in, false) ELSE coalesce(was_in, false) END, 'clock' FROM clock""")
_add("scalar_functions", f"""
SELECT l_orderkey, l_linenumber, {cents('l_extendedprice * l_discount')} AS half_up,
  CAST(CASE WHEN rest * 2 > 80 OR (rest * 2 = 80 AND whole % 2 = 1) THEN whole + 1 ELSE whole END AS DOUBLE) / 100.0::DOUBLE AS half_even,
  CASE WHEN l_returnflag = l_linestatus THEN 4.0::DOUBLE ELSE 6.0::DOUBLE END AS map_sum,
  CAST(floor(l_extendedprice) AS BIGINT) AS floored, substr(l_linestatus, 1, 1) AS head, l_returnflag AS unquoted,
  l_returnflag <> 'N' AS flag, l_returnflag AS after_dot, CAST(NULL AS DOUBLE) AS not_a_number,
  least(l_extendedprice, 20000.0::DOUBLE) AS capped, greatest(l_extendedprice, 20000.0::DOUBLE) AS raised
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) // 80 AS whole, CAST(round(l_extendedprice * 100) AS BIGINT) % 80 AS rest
      FROM lineitem)""")


# Streaming: same tables as the batch queries -------------------------------------------------------------------------

for _stream, _batch in {
    "stream_employee_info": "employee_info", "stream_hours": "hours_by_period", "stream_gross_pay": "gross_pay_by_period",
    "stream_net_pay": "net_pay_asof",
}.items():
    _add(_stream, ORACLE[_batch])
_add("stream_search", _with(
    SQL_LOG, GROSS_EVENTS, GROSS, DEDUCTIONS, GONE, _ASOF, INFO,
    breakdown("net", "(SELECT * FROM probes LEFT JOIN asof_tax USING (emp, per) LEFT JOIN asof_totals USING (emp, per))"),
    DOCS,
) + """
SELECT d.employee_id, first_name, email, COUNT(p.pay_period_number) AS periods,
  round(coalesce(SUM(p.net_pay), 0.0::DOUBLE), 2) AS net_pay_sum
FROM docs d LEFT JOIN periods p ON d.employee_id = p.employee_id WHERE is_active GROUP BY ALL""")
_add("stream_projection", _with(SQL_LOG, ACCEPTED, RECORD) + """
SELECT emp AS employee_id, first_name, is_active, last_event_type, last_event_id, epoch_us(last_event) AS last_event_us FROM record""")
_add("stream_change_feed", _with(SQL_LOG, ACCEPTED) + """
SELECT off, emp AS employee_id, split_part(event_type, '.', 2) AS change_type FROM accepted""")
# The log arrives in five parts of equal offset range. Each part emits the pay rows it touched, and in the current period
# those of employees whose settings changed, unless the employee was deactivated by then.
_add("stream_pay_updates", _with(
    SQL_LOG, GROSS_EVENTS,
    ACCEPTED.replace("UNION ALL SELECT * REPLACE ((off + 40) * 2 + 1 AS off) FROM log WHERE kind = 'signup' AND off % 10 = 0", ""),
) + """
, parts AS (SELECT MAX(event_id) + 1 AS n FROM events),
gross_at AS (SELECT emp, per, off, off * 5 // n AS part FROM gpe, parts),
setting_at AS (SELECT emp, off, off * 5 // n AS part FROM log, parts WHERE kind IN ('error', 'purchase')),
gone_at AS (SELECT emp, MIN(off * 5 // n) AS part FROM log, parts WHERE event_type = 'employee.deactivated' GROUP BY emp),
due AS (
  SELECT emp, per, part FROM gross_at
  UNION SELECT s.emp, 2, s.part FROM setting_at s JOIN gross_at g ON g.emp = s.emp AND g.per = 2 AND g.part <= s.part
),
causes AS (
  SELECT d.emp, d.per, d.part, g.off FROM due d JOIN gross_at g ON g.emp = d.emp AND g.per = d.per AND g.part <= d.part
  UNION ALL SELECT d.emp, d.per, d.part, s.off FROM due d JOIN setting_at s ON s.emp = d.emp AND s.part <= d.part WHERE d.per = 2
),
emitted AS (
  SELECT c.emp, per, c.part, MAX(off) AS off FROM causes c LEFT JOIN gone_at x ON x.emp = c.emp
  WHERE x.emp IS NULL OR x.part > c.part GROUP BY ALL
),
firsts AS (SELECT emp, MIN(off) // 2 AS first_off FROM accepted GROUP BY emp),
placed AS (
  SELECT e.*, (SELECT COUNT(*) FROM accepted a WHERE a.emp = e.emp AND a.event_type = 'employee.deactivated' AND a.off // 2 <= e.off) AS segment
  FROM emitted e JOIN firsts f ON f.emp = e.emp WHERE e.off >= first_off
),
counted AS (
  SELECT * FROM placed QUALIFY per >= coalesce(
    MAX(per) OVER (PARTITION BY emp, segment ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), per)
)
SELECT off // 2 AS off, emp AS employee_id, split_part(event_type, '.', 2) AS change_type FROM accepted
UNION ALL SELECT off, emp, 'payUpdated' FROM counted""")
_add("stream_replay", ORACLE["gross_pay_by_period"])
