import random
import re

import pytest
from helpers import event, rows
from scenario import PERIOD, payloads

from paywright.functions import tax
from paywright.operators import extract, netpay, pay, people
from paywright.plans.payroll import Payroll
from paywright.sources.event_log import events_of, land, read_landed, resolve_identity


def test_hours_of_the_scenario(make_events):
    got = rows(Payroll.of(make_events(payloads())).hours(), "employee_id", "pay_period_number")
    per_employee = [
        (8, 33.0, 5, "2024-04-22T00:00:00", "2024-05-06T00:00:00"),
        (9, 27.75, 4, "2024-05-06T00:00:00", "2024-05-20T00:00:00"),
        (10, 33.0, 5, "2024-05-20T00:00:00", "2024-06-03T00:00:00"),
        (11, 33.75, 5, "2024-06-03T00:00:00", "2024-06-17T00:00:00"),
        (12, 20.25, 3, "2024-06-17T00:00:00", "2024-07-01T00:00:00"),
    ]
    assert got == [(e, *r) for e in ("w-kofi", "w-tomas") for r in per_employee]


# gross, federal, state, all tax, fixed, percent, all deductions, net. Ines, for one: 62400 / 2080 * 38 = 1140; a year of it,
# 29640, is taxed 2320 + 12 % of 6440, which is 118.95 a period; 9.9 % for the state; 10 more for the federation.
NET = {
    "w-ines": (1140.00, 118.95, 112.86, 241.81, 120, 45.60, 165.60, 732.59),
    "w-tomas": (739.20, 79.78, 72.81, 160.09, 95, 0, 95, 484.11),
    "w-priya": (2052.00, 261.17, 0, 286.17, 95, 153.90, 248.90, 1516.93),
    "w-kofi": (1353.00, 153.44, 74.28, 227.72, 0, 0, 0, 1125.28),
    "w-lena": (1000.00, 102.15, 57.50, 171.65, 0, 0, 0, 828.35),
}


@pytest.mark.parametrize("mode", ["snapshot", "asof"])
def test_net_pay_of_the_scenario(make_events, mode):
    table = Payroll.of(make_events(payloads())).net_pay(mode, current_period=PERIOD).filter(f"pay_period_number = {PERIOD}")
    names = ["gross_pay", "federal_tax", "state_tax", "total_tax", "total_fixed_deductions", "total_percent_deductions",
             "total_deductions", "net_pay"]
    got = {r["employee_id"]: tuple(r[n] for n in names) for r in table.collect()}
    assert got == {k: pytest.approx(v) for k, v in NET.items()}


def test_rate_of_another_period_is_not_carried(make_events):
    table = Payroll.of(make_events(payloads("2023-06-01T00:00:00Z"))).gross_pay().filter(f"pay_period_number = {PERIOD}")
    assert {r["gross_pay"] for r in table.collect()} == {None}


def test_landed_log_gives_the_same(spark, make_log, make_events, tmp_path):
    land(make_log(payloads()), str(tmp_path / "log"))
    landed = Payroll.landed(spark, str(tmp_path / "log"))
    key = ("employee_id", "pay_period_number")
    assert rows(landed.net_pay(), *key) == rows(Payroll.of(make_events(payloads())).net_pay(), *key)
    plan = extract.time_entry_events(landed.source("timeentry"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*topic#\d+ = timeentry-events", plan)
    assert re.search(r"PushedFilters: \[[^]]*In\(event_type, \[timeentry.clockedout,timeentry.updated\]\)", plan)


def _entry(i, hours, clock_in="2024-01-02T08:00:00Z", kind="timeentry.clockedout"):
    return event(kind, Id=i, EmployeeId="e", ClockIn=clock_in, HoursWorked=hours)


def test_edit_replaces_and_counts(make_events):
    log = [_entry("a", 8), _entry("b", 4), _entry("a", 6.5, kind="timeentry.updated")]
    assert rows(Payroll.of(make_events(log)).hours())[0][:4] == ("e", 0, 10.5, 3)


def test_entry_moved_to_another_period_leaves_its_old_hours(make_events):
    log = [_entry("a", 8), _entry("a", 8, "2024-01-16T08:00:00Z", "timeentry.updated")]
    got = rows(Payroll.of(make_events(log)).hours().select("pay_period_number", "total_hours_worked"), "pay_period_number")
    assert got == [(0, 8.0), (1, 8.0)]


def test_order_of_different_entries_does_not_matter(make_events):
    log = [_entry(str(i % 7), i / 10) for i in range(40)]
    by_entry = {}
    for i in range(40):
        by_entry[str(i % 7)] = i / 10
    want = round(sum(by_entry.values()), 6)
    for seed in (1, 2):
        shuffled = sorted(range(40), key=lambda i: (random.Random(seed * 100 + i % 7).random(), i))
        got = rows(Payroll.of(make_events([log[i] for i in shuffled])).hours())[0][2]
        assert round(got, 6) == want


def test_incomplete_keys_and_junk_are_skipped(make_log, spark):
    from paywright.sources.event_log import events_of

    good = make_log([_entry("a", 8), event("timeentry.clockedout", Id="x", EmployeeId="e", ClockIn="soon", HoursWorked=1)])
    junk = spark.createDataFrame([(90, "{not json"), (91, '{"data": null}'), (92, None), (93, '{"type": "t"}')], good.schema)
    assert rows(Payroll.of(events_of(good.union(junk))).hours().select("total_hours_worked")) == [(8.0,)]


def test_object_and_text_payloads_agree(spark):
    import json

    from paywright.sources.event_log import events_of

    inner = _entry("a", 8)
    log = [(0, json.dumps({"data": inner})), (1, json.dumps({"data": json.loads(_entry("b", 2))}))]
    assert rows(Payroll.of(events_of(spark.createDataFrame(log, "off bigint, value string"))).hours())[0][2] == 10.0
    bare = [(0, inner)]
    raw = spark.createDataFrame(bare, "off bigint, value string")
    assert events_of(raw).count() == 0
    assert events_of(raw, body_fallback=True).count() == 1


def _brackets(income, table):
    total, lower = 0.0, 0.0
    for upper, rate in table:
        if income <= lower:
            break
        total += (min(income, upper or 1e308) - lower) * rate
        lower = upper
    return total


def test_federal_tax_matches_a_loop(spark):
    import math

    cases = [(g, f) for g in (-5.0, 0.0, 100.0, 446.15, 1813.4, 9000.0, 40000.0) for f in ("Single", "MARRIED", None, "odd")]
    df = spark.createDataFrame(cases, "g double, f string")
    for g, f, got in df.select("g", "f", tax.federal_tax("g", "f")).collect():
        table = tax.MARRIED_BRACKETS if (f or "").lower() in tax.MARRIED_STATUSES else tax.SINGLE_BRACKETS
        assert got == math.floor(_brackets(g * 26, table) / 26 * 100 + 0.5) / 100


def test_state_tax_edges(spark):
    df = spark.createDataFrame([(1000.0, "ca"), (1000.0, "ZZ"), (1000.0, None), (1000.0, ""), (-1000.0, "NY")], "g double, s string")
    assert [r[0] for r in df.select(tax.state_tax(df.g, df.s)).collect()] == [93.0, 0.0, 0.0, 0.0, -68.5]


def test_deduction_state_and_totals(make_events):
    ded = lambda kind, i, **f: event(f"deduction.{kind}", Id=i, EmployeeId="e", **f)
    log = [
        ded("created", "a", Amount=100, IsPercentage=False, IsActive=True),
        ded("created", "b", Amount=5, IsPercentage=True, IsActive=True),
        ded("deactivated", "a", Amount=1, IsPercentage=True),
        ded("deactivated", "never-seen"),
        ded("updated", "c", IsActive=True),
        event("deduction.created", EmployeeId="e", Amount=7),
    ]
    state = people.deduction_state(extract.deduction_events(make_events(log)))
    assert rows(state, "deduction_id") == [
        ("e", "a", 100.0, False, False), ("e", "b", 5.0, True, True), ("e", "c", 0.0, False, True),
        ("e", "never-seen", 0.0, False, False),
    ]
    assert rows(people.deduction_totals(state)) == [("e", 0.0, 0.05)]


def _simulate(log, current):
    """The net-pay job record by record, on (off, kind, employee, detail) tuples."""
    gross, settings, out = {}, {}, {}

    def emit(emp, per):
        s = settings.get(emp, {})
        out[(emp, per)] = (gross[(emp, per)], s.get("extra", 0.0), round(sum(s.get("ded", {}).values()), 6))

    for kind, emp, detail in log:
        if kind == "gross":
            per, amount = detail
            gross[(emp, per)] = amount
            emit(emp, per)
        else:
            s = settings.setdefault(emp, {"extra": 0.0, "ded": {}})
            if kind == "tax":
                s["extra"] = detail
            else:
                s["ded"][detail[0]] = detail[1]
            if (emp, current) in gross:
                emit(emp, current)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_asof_net_pay_matches_record_by_record(spark, seed):
    rnd = random.Random(seed)
    log = []
    for _ in range(300):
        emp = rnd.choice(["hot", "hot", "hot", "b", "c"])
        kind = rnd.choice(["gross", "tax", "ded"])
        detail = {
            "gross": (rnd.randrange(5), float(rnd.randrange(100, 900))),
            "tax": float(rnd.randrange(50)),
            "ded": (f"d{rnd.randrange(6)}", float(rnd.randrange(20))),
        }[kind]
        log.append((kind, emp, detail))
    want = _simulate(log, current=3)

    last = {}
    for off, (kind, emp, detail) in enumerate(log):
        if kind == "gross":
            last[(emp, detail[0])] = (detail[1], off)
    gross = spark.createDataFrame(
        [(e, p, g, 1.0, "1", 1.0, "", "", o) for (e, p), (g, o) in last.items()],
        "employee_id string, pay_period_number bigint, gross_pay double, pay_rate double, pay_type string, "
        "total_hours_worked double, pay_period_start string, pay_period_end string, last_off bigint",
    )
    taxes = spark.createDataFrame(
        [(o, e, "Single", "TX", d, 0.0) for o, (k, e, d) in enumerate(log) if k == "tax"],
        "off bigint, employee_id string, federal_filing_status string, state string, "
        "additional_federal_withholding double, additional_state_withholding double",
    )
    deds = spark.createDataFrame(
        [(o, e, d[0], "deduction.updated", d[1], False, True) for o, (k, e, d) in enumerate(log) if k == "ded"],
        "off bigint, employee_id string, deduction_id string, event_type string, amount double, is_percentage boolean, "
        "is_active boolean",
    )
    table = netpay.net_pay_asof(gross, taxes, deds, current_period=3)
    got = {
        (r["employee_id"], r["pay_period_number"]): (
            r["gross_pay"], r["additional_federal_withholding"], round(r["total_fixed_deductions"], 6)
        )
        for r in table.collect()
    }
    assert got == want


def test_deactivation_is_for_good(make_events):
    extra = [
        event("employee.deactivated", Id="w-ines", UpdatedAt="2024-05-28T00:00:00Z"),
        event("employee.activated", Id="w-ines", UpdatedAt="2024-05-29T00:00:00Z"),
    ]
    p = Payroll.of(make_events(payloads() + extra))
    assert "w-ines" not in {r[0] for r in p.net_pay().collect()}
    keys = p.gross_pay().select("employee_id", "pay_period_number")
    assert rows(netpay.purge(keys, p.deactivated()).select("key", "value")) == [
        ('{"EMPLOYEE_ID":"w-ines","PAY_PERIOD_NUMBER":10}', None)
    ]


def test_partials_merge_to_the_same_table(make_events):
    events = extract.gross_pay_events(make_events(payloads()))
    halves = [pay.entry_partials(events.filter(f"off % 2 = {i}")) for i in (1, 0)]
    merged = pay.gross_from_partials(pay.merge_partials(halves[0].union(halves[1])))
    key = ("employee_id", "pay_period_number")
    assert rows(merged, *key) == rows(pay.gross_pay_by_period(events), *key)


def test_landing_keeps_every_record(spark, make_log, tmp_path):
    direct = {"EventId": "e-1", "EventType": "employee.updated", "EmployeeId": "x", "OccurredOn": "2024-01-02T08:00:00Z"}
    untyped = {"Id": "y"}
    raw = make_log([direct, untyped, *payloads()])
    land(raw, str(tmp_path / "log"))
    landed = read_landed(spark, str(tmp_path / "log"))
    assert landed.count() == len(payloads()) + 2
    seen = lambda events: sorted(tuple(r) for r in resolve_identity(events).select("off", "employee_id", "event_id", "event_type").collect())
    assert seen(landed) == seen(events_of(raw))
    assert {r["topic"] for r in spark.read.parquet(str(tmp_path / "log")).where("off < 2").select("topic").collect()} == {"employee-events", "unknown"}
