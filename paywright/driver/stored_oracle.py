"""SQL counterparts of the queries over laid-out data."""

from __future__ import annotations

from paywright.driver.oracle import ORACLE, _add, _with
from paywright.driver.tables import EMPLOYEE_ID_STEM, SQL_LOG

_add("landed_net_pay", ORACLE["net_pay"])
_add("landed_topics", ORACLE["event_topic_routing"])
_add("logged_hours", ORACLE["hours_by_period"])
_add("written_changelog", f"SELECT * EXCLUDE (pay_period_number) FROM ({ORACLE['compacted_table']})")
_add("upsert_touched", _with(SQL_LOG) + """
SELECT emp AS employee_id, id AS deduction_id, amount, is_percentage
FROM (SELECT * FROM log WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY emp, id ORDER BY off DESC) = 1)
WHERE event_type <> 'deduction.deactivated'""")
_add("stream_net_pay_state", ORACLE["stream_net_pay"])
_add("search_indexed", ORACLE["search_simple"])
_add("search_indexed_keyword", ORACLE["search_simple_keyword"])
_add("net_pay_bucketed", ORACLE["net_pay"])
_add("duty_brackets", """
WITH base(bracket, a, b, rate) AS (VALUES
  (0, 0.0::DOUBLE, 2000.0::DOUBLE, 0.05::DOUBLE), (1, 2000.0, 8000.0, 0.10), (2, 8000.0, 20000.0, 0.15), (3, 20000.0, 45000.0, 0.20),
  (4, 45000.0, 80000.0, 0.25), (5, 80000.0, 150000.0, 0.30), (6, 150000.0, NULL, 0.35)),
prices AS (
  SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
scaled AS (SELECT *, 1 + nation / 50.0::DOUBLE + (year - 1990) / 20.0::DOUBLE AS f FROM prices)
SELECT nation, year, bracket, COUNT(*) AS n, CAST(SUM(CAST(floor((price - a * f) * rate * 100 + 0.5) AS BIGINT)) AS BIGINT) AS duty_cents
FROM scaled JOIN base ON price >= a * f AND (b IS NULL OR price < b * f) GROUP BY ALL""")
_add("lookup_pruned", f"""
SELECT * FROM ({ORACLE['net_pay']}) WHERE employee_id IN ({', '.join(f"'{EMPLOYEE_ID_STEM}{n:012d}'" for n in (3, 17, 58, 99, 100_000))})""")
_add("search_page_observed", ORACLE["search_page"])
_add("stream_replay_stats", ORACLE["replay_stats"])
_add("stream_pay_notices", """
SELECT event_id AS off, user_id AS employee_id FROM events e WHERE event_type = 'click' AND EXISTS (
  SELECT 1 FROM events r WHERE r.event_type = 'signup' AND r.user_id = e.user_id
    AND r.ts >= e.ts - INTERVAL 8 DAYS AND r.ts <= e.ts + INTERVAL 36 HOURS)""")
_add("rebuilt_projection", f"""
SELECT i.*, CAST(0 AS INTEGER) AS dropped_first, (
  SELECT CAST(COUNT(DISTINCT user_id) AS INTEGER) FROM events
  WHERE event_type = 'signup' AND event_id <= (SELECT MAX(event_id) // 2 FROM events WHERE event_type = 'signup')) AS dropped_second
FROM ({ORACLE['employee_info']}) i""")

_FORMS = f"""
SELECT off, CASE WHEN k % 20 = 17 THEN NULL WHEN k % 10 = 7 OR kind = 'signup' THEN emp ELSE id END AS employee_id,
  CASE WHEN k % 20 <> 17 THEN event_id END AS event_id,
  CASE WHEN k % 20 = 17 THEN '' WHEN k % 10 = 7 THEN 'projected.' || kind ELSE event_type END AS event_type,
  CASE WHEN k % 20 = 17 THEN NULL WHEN k % 10 = 7 THEN epoch_us(ts) ELSE epoch_us(occurred_on) END AS occurred_us
FROM log"""
_add("event_identity_forms", _with(SQL_LOG) + _FORMS)
_add("landed_identity_forms", f"""
SELECT *, CASE WHEN event_type = '' THEN 'unknown' ELSE split_part(event_type, '.', 1) || '-events' END AS topic
FROM ({_with(SQL_LOG)} {_FORMS})""")

_PAID = f"""
shifts AS (
  SELECT '{EMPLOYEE_ID_STEM}' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS employee_id, o_custkey, o_orderkey,
    CAST(epoch(date_trunc('second', o_orderdate + INTERVAL 32 YEARS)) AS BIGINT) * 1000 AS ms,
    (ms - 1704067200000) // 1209600000 AS pay_period_number, CAST(1 + o_orderkey % 9 AS DOUBLE) AS hours, CAST(10 + o_orderkey % 31 AS DOUBLE) AS rate
  FROM orders
),
paid AS (
  SELECT employee_id, o_custkey, pay_period_number, SUM(hours) AS total_hours_worked,
    floor(arg_max(rate, o_orderkey) * SUM(hours) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS net_pay
  FROM shifts GROUP BY ALL
),
kept AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY pay_period_number DESC) AS rn FROM paid QUALIFY rn <= 4)"""
_add("orders_last4_periods", f"WITH {_PAID} SELECT employee_id, pay_period_number, total_hours_worked, net_pay FROM kept")
_add("orders_search_page", f"""
WITH {_PAID}, hits AS (SELECT employee_id, 'buyer' || o_custkey || '@example.com' AS email, COUNT(*) AS periods FROM kept WHERE o_custkey % 10 <> 3 GROUP BY ALL)
SELECT *, (SELECT COUNT(*) FROM hits) AS total_hits FROM hits ORDER BY employee_id LIMIT 200""")
