import random
from datetime import datetime, timedelta, timezone

import pytest
from helpers import event, rows

from paywright.functions.ordered import Running, with_running
from paywright.operators import checks, lookups, projection
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _changes(spark, events):
    """(off, employee, event id, kind, minute) to the flattened change rows."""
    data = [
        (off, e, i, f"employee.{k}", T0 + timedelta(minutes=m), k in ("created", "updated", "activated"),
         (f"name{off}", "", "", "1", None, None) if k in ("created", "updated") else None)
        for off, e, i, k, m in events
    ]
    return spark.createDataFrame(
        data,
        "off bigint, employee_id string, event_id string, event_type string, occurred_on timestamp, is_active boolean, "
        "fields struct<first_name: string, last_name: string, email: string, pay_type: string, "
        "pay_rate: decimal(18,2), pay_period_hours: decimal(18,2)>",
    )


def _random_events(seed, n=400):
    rnd = random.Random(seed)
    made = []
    for off in range(n):
        emp = rnd.choice(["hot"] * 6 + ["b", "c", "d"])
        if made and rnd.random() < 0.15:
            _, e, i, k, m = rnd.choice(made)
            made.append((off, e, i, k, m))
        else:
            kind = rnd.choice(["created", "updated", "activated", "deactivated"])
            made.append((off, emp, f"ev{off}", kind, off + rnd.randrange(-60, 60)))
    return made


def _accept(events):
    last, kept = {}, []
    for off, e, i, k, m in events:
        if e in last and (last[e][0] == i or last[e][1] >= m):
            continue
        last[e] = (i, m)
        kept.append(off)
    return kept


@pytest.mark.parametrize("block_rows", [3, 50, 1 << 20])
def test_acceptance_matches_record_by_record(spark, block_rows):
    events = _random_events(7)
    got = projection.accepted_events(_changes(spark, events), block_rows=block_rows)
    assert sorted(r[0] for r in got.select("off").collect()) == _accept(events)


def test_replaying_the_log_changes_nothing(spark):
    events = _random_events(8)
    again = [(off + 1000, *rest) for off, *rest in events]
    once = projection.employee_record(projection.accepted_events(_changes(spark, events)))
    twice = projection.employee_record(projection.accepted_events(_changes(spark, events + again)))
    assert rows(once, "employee_id") == rows(twice, "employee_id")


def test_record_from_deactivation_only(spark):
    record = projection.employee_record(projection.accepted_events(_changes(spark, [(0, "e", "x", "deactivated", 5)])))
    r = record.collect()[0]
    assert (r.first_name, r.pay_rate, float(r.pay_period_hours), r.is_active) == ("", None, 40.0, False)


def test_activation_keeps_the_fields(spark):
    events = [(0, "e", "x", "created", 1), (1, "e", "y", "deactivated", 2), (2, "e", "z", "activated", 3)]
    r = projection.employee_record(projection.accepted_events(_changes(spark, events))).collect()[0]
    assert (r.first_name, r.is_active, r.last_event_id, r.last_deactivated_off) == ("name0", True, "z", 1)


def test_equal_timestamps_reject_the_later(spark):
    events = [(0, "e", "x", "created", 1), (1, "e", "y", "updated", 1)]
    assert [r.off for r in projection.accepted_events(_changes(spark, events)).collect()] == [0]


def test_identity_of_both_payload_forms(make_events):
    direct = event("ignored", Id="row", EventId="11111111-0000-0000-0000-000000000000", EventType="employee.updated",
                   EmployeeId="emp", OccurredOn="2024-01-05T00:00:00Z")
    empty = event("employee.created", event_id="n1", occurred_on="2024-01-06T00:00:00Z", Id="row",
                  EventId="00000000-0000-0000-0000-000000000000", EventType="employee.updated", EmployeeId="emp")
    from paywright.sources.event_log import resolve_identity

    got = rows(resolve_identity(make_events([direct, empty])).select("employee_id", "event_id", "event_type"), "event_type")
    assert got == [("row", "n1", "employee.created"), ("emp", "11111111-0000-0000-0000-000000000000", "employee.updated")]


def test_members_in_camel_case(make_events):
    import json

    low = json.dumps({"id": "e", "firstName": "Ann", "domainEvents": [{"eventId": "x", "eventType": "employee.created",
                                                                       "occurredOn": "2024-01-06T00:00:00Z"}]})
    got = projection.employee_changes(make_events([low])).select("employee_id", "event_id", "fields.first_name")
    assert rows(got) == [("e", "x", "Ann")]


EMPS = ["00000000-0000-4000-8000-00000000000a", "00000000-0000-4000-8000-00000000000b"]


def test_pay_rows_match_record_by_record(spark):
    rnd = random.Random(3)
    stream = []
    for off in range(200):
        emp = rnd.choice([EMPS[0], EMPS[0], EMPS[1]])
        kind = "off" if rnd.random() < 0.1 else ("on" if rnd.random() < 0.15 else "pay")
        stream.append((off, emp, kind, rnd.randrange(6)))
    exists, shown, counted = set(), {}, []
    for off, emp, kind, per in stream:
        if kind == "pay":
            if emp in exists and (emp not in shown or per >= shown[emp][0]):
                shown[emp] = (per, off)
                counted.append(off)
        else:
            exists.add(emp)
            if kind == "off":
                shown.pop(emp, None)
    changes = [(o, e, f"ev{o}", "deactivated" if k == "off" else "updated", o) for o, e, k, _ in stream if k != "pay"]
    accepted = projection.accepted_events(_changes(spark, changes))
    pay = spark.createDataFrame(
        [(o, e, p, *[1.005] * 10, 1.0, 1.0, "1", "", "") for o, e, k, p in stream if k == "pay"],
        ["off", "employee_id", "pay_period_number", *projection.NET_PAY_AMOUNTS, "pay_rate", "total_hours_worked",
         "pay_type", "pay_period_start", "pay_period_end"],
    )
    table = projection.pay_attributes(pay, projection.employee_record(accepted))
    assert {r.employee_id: (r.pay_period_number, r.off) for r in table.collect()} == shown
    assert sorted(r.off for r in projection.pay_changes(pay, accepted).collect()) == counted
    odd = pay.withColumn("employee_id", F.lit("not-a-guid"))
    assert projection.valid_pay_rows(odd).count() == 0


@pytest.mark.parametrize("kind", ["max", "sum", "last"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_values_do_not_depend_on_blocks(spark, kind, inclusive):
    rnd = random.Random(1)
    data = [(o, rnd.choice(["hot", "hot", "x"]), rnd.choice([None, *range(9)])) for o in range(300)]
    df = spark.createDataFrame(data, "off bigint, k string, v bigint")
    results = [
        rows(with_running(df, ["k"], {"r": Running(kind, F.col("v"), inclusive)}, block_rows=b), "off") for b in (4, 37, 10**6)
    ]
    seen, want = {}, []
    for o, k, v in data:
        before = seen.get(k)
        after = before if v is None else {"max": max(before or v, v), "sum": (before or 0) + v, "last": v}[kind]
        seen[k] = after
        want.append((o, k, v, after if inclusive else before))
    assert results[0] == results[1] == results[2] == want


def test_clock_events(spark):
    rnd = random.Random(5)
    data = [(o, rnd.choice(["hot", "hot", "x"]), rnd.choice(["in", "out"])) for o in range(120)]
    inside, want = {"x"}, []
    for o, e, a in data:
        ok = (e not in inside) if a == "in" else (e in inside)
        if ok:
            inside.symmetric_difference_update({e})
        want.append((o, e, a, ok))
    df = spark.createDataFrame(data, "off bigint, employee_id string, action string")
    open_before = spark.createDataFrame([("x",)], "employee_id string")
    assert rows(checks.check_clock_events(df, open_before, block_rows=5), "off") == want


def test_first_per_key_and_reference(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "off bigint, employee_id string")
    existing = spark.createDataFrame([("b",)], "employee_id string")
    assert [r[2] for r in rows(checks.check_first_per_key(df, "employee_id", existing), "off")] == [True, False, False, True]
    parents = spark.createDataFrame([(-1, "a"), (5, "a"), (-2, "c"), (7, "b")], "off bigint, id string")
    assert [r[2] for r in rows(checks.check_reference(df, parents, "employee_id", "id"), "off")] == [True, False, True, True]
    late = spark.createDataFrame([(2, "a"), (0, "b")], "off bigint, id string")
    assert [r[2] for r in rows(checks.check_reference(df, late, "employee_id", "id"), "off")] == [False, True, False, False]


def test_pay_row_of_the_event_that_made_the_record(spark):
    accepted = projection.accepted_events(_changes(spark, [(5, EMPS[0], "ev5", "created", 5)]))
    names = ["off", "employee_id", "pay_period_number", *projection.NET_PAY_AMOUNTS, "pay_rate", "total_hours_worked",
             "pay_type", "pay_period_start", "pay_period_end"]
    paid = lambda off, net: (off, EMPS[0], 3, *[net] * 10, 1.0, 1.0, "2", "", "")
    for order in ([paid(5, 1.0), paid(9, 2.0)], [paid(9, 2.0), paid(5, 1.0)]):
        pay = spark.createDataFrame(order, names)
        shown = projection.pay_attributes(pay, projection.employee_record(accepted)).select("off", "net_pay").collect()
        assert [(r.off, float(r.net_pay)) for r in shown] == [(9, 2.0)]
        assert rows(projection.change_feed(accepted, pay), "off", "change_type") == [
            (5, EMPS[0], "created"), (5, EMPS[0], "payUpdated"), (9, EMPS[0], "payUpdated")
        ]


def test_hours_check(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, TIMESTAMP '2024-01-01 08:00:00', TIMESTAMP '2024-01-01 16:07:30'),
        (2, TIMESTAMP '2024-01-01 08:00:00', CAST(NULL AS TIMESTAMP)),
        (3, TIMESTAMP '2024-01-01 08:00:00', TIMESTAMP '2024-01-01 08:00:00') AS t(id, clock_in, clock_out)""")
    got = rows(checks.check_hours(df).selectExpr("cast(hours_worked as double)", "rejected"))
    assert got == [(8.12, False), (0.0, False), (None, True)]


def test_merge_changes(spark):
    now = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    change = spark.createDataFrame([("b", None), ("c", "z")], "id string, name string")
    assert rows(lookups.merge_changes(now, change, "id"), "id") == [("a", "x", 1), ("b", "y", 2), ("c", "z", None)]
    assert rows(lookups.merge_changes(now, change, "id", null_is_absent=False), "id")[1] == ("b", None, 2)


def test_prefer_and_open_entry(spark):
    a = spark.createDataFrame([("1", "left")], "id string, v string")
    b = spark.createDataFrame([("1", "right"), ("2", "right")], "id string, v string")
    assert rows(lookups.prefer(a, b, "id"), "id") == [("1", "left"), ("2", "right")]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_is_a_plain_join(spark, how):
    from paywright.functions.skew import join_one_per_key

    df = spark.createDataFrame([(o, "hot" if o % 3 else f"k{o % 9}") for o in range(90)], "off bigint, k string")
    one = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    for salts in (1, 7):
        got = join_one_per_key(df, one, ["k"], how, salts=salts)
        assert rows(got, "off") == rows(df.join(one, ["k"], how), "off")


def test_salted_join_broadcasts_nothing(spark):
    from paywright.functions.skew import join_one_per_key

    got = join_one_per_key(spark.range(9).selectExpr("id AS off", "id AS k"), spark.range(3).selectExpr("id AS k"), ["k"])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
