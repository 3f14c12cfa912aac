import json

from helpers import event, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright.functions import labels, periods, scalars
from paywright.functions.aggregates import latest_present
from paywright.operators import people
from paywright.sources import changelog, event_log


def test_compacted_table(spark):
    changes = spark.createDataFrame(
        [(0, "a", "1"), (1, "b", "1"), (2, "a", None), (3, "c", None), (4, "c", "2"), (5, "b", "3")],
        "off bigint, key string, value string",
    )
    table = changelog.table_from_changelog(changes, ["key"])
    assert rows(table.select("key", "value"), "key") == [("b", "3"), ("c", "2")]


def test_changelog_round_trip(spark):
    df = spark.createDataFrame([(7, 'e"1', 3, 1.5, None)], "off bigint, employee_id string, n bigint, pay double, note string")
    two = changelog.to_changelog(df, ["employee_id", "n"])
    row = two.collect()[0]
    assert json.loads(row.key) == {"EMPLOYEE_ID": 'e"1', "N": 3} and json.loads(row.value) == {"PAY": 1.5}
    back = changelog.parse_changelog(two, df.select("employee_id", "n").schema, df.select("pay", "note").schema)
    assert rows(back) == [(7, 'e"1', 3, 1.5, None)]
    one = changelog.to_changelog(df, ["employee_id"], deleted=F.lit(True))
    assert rows(one.select("key", "value")) == [('"e\\"1"', None)]
    kept = changelog.parse_changelog(changelog.to_changelog(df, ["employee_id"]), df.select("employee_id").schema, df.select("n").schema)
    assert rows(kept) == [(7, 'e"1', 3)]


def test_key_forms(spark):
    df = spark.createDataFrame([('"abc"',), ('{"EMPLOYEE_ID":"abc","N":1}',), ("abc-1",), ('{"X":1}',), (None,)], "key string")
    got = [r[0] for r in df.select(changelog.employee_of_key(F.col("key"))).collect()]
    assert got == ["abc", "abc", "abc-1", None, None]


def test_upsert(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    changes = spark.createDataFrame(
        [(0, "a", 10, False), (1, "a", 11, False), (2, "b", None, True), (3, "d", 4, False), (4, "e", 5, False), (5, "e", None, True)],
        "off bigint, id string, v int, gone boolean",
    )
    assert rows(changelog.upsert(target, changes, ["id"], F.col("gone")), "id") == [("a", 11), ("c", 3), ("d", 4)]


def test_latest_skips_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None)], "off bigint, v double")
    assert df.agg(latest_present(F.col("v"), F.col("off"))).collect()[0][0] == 2.0
    assert df.filter("v is null").agg(latest_present(F.col("v"), F.col("off"))).collect()[0][0] is None


def test_periods(spark):
    cases = {
        "2024-01-01T00:00:00Z": 0, "2024-01-14T23:59:59.999Z": 0, "2024-01-15T00:00:00": 1, "2026-01-19T08:00:00Z": 53,
        "2023-12-20T00:00:00Z": 0, "2023-12-17T00:00:00Z": -1, "junk": None, "2024-01-01": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {t: n for t, n in df.select("t", periods.period_of_text(F.col("t"))).collect()} == cases
    bounds = spark.range(53, 54).select(periods.period_start(F.col("id")), periods.period_end(F.col("id")))
    assert rows(bounds) == [("2026-01-12T00:00:00", "2026-01-26T00:00:00")]


def test_rounding(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (-0.125,)], "v double")
    assert [r[0] for r in df.select(scalars.round_cents(df.v)).collect()] == [1.0, 2.68, -1.0, -0.12]
    halves = spark.sql("SELECT cast(v AS decimal(10,3)) v FROM VALUES (8.125), (8.135), (8.1251) AS t(v)")
    assert [float(r[0]) for r in halves.select(scalars.round_half_even(F.col("v"))).collect()] == [8.12, 8.14, 8.12]


def test_flags_and_text(spark):
    df = spark.createDataFrame([("true",), ("FALSE",), ("1",), ("0",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.as_flag(df.t, True)).collect()] == [True, False, True, False, True, True]
    assert [r[0] for r in df.select(scalars.unless_false(df.t)).collect()] == [True, False, True, True, True, True]
    one = spark.range(1)
    assert one.select(scalars.change_type(F.lit("employee.created")), scalars.change_type(F.lit("odd"))).collect()[0][:] == ("created", "odd")
    assert one.select(event_log.topic_of(F.lit("taxinfo.updated"))).collect()[0][0] == "taxinfo-events"
    assert one.select(labels.pay_type_label(F.lit("2")), labels.deduction_type_label(F.lit(99)), labels.pay_type_label(F.lit(7))).collect()[0][:] == ("Salary", "Other", None)


def test_map_last_wins(spark):
    df = spark.sql("SELECT array('a', 'b', 'a') k, array(1.0D, 2.0D, 5.0D) v")
    out = df.select(scalars.map_last_wins(df.k, df.v).alias("m")).select("m", scalars.sum_array(F.map_values("m"))).collect()[0]
    assert out[0] == {"a": 5.0, "b": 2.0} and out[1] == 7.0


def test_exact_sum_keeps_huge_values(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (1e25,)], "v double")
    assert df.agg(scalars.exact_sum(df.v)).collect()[0][0] == 1e25
    assert df.filter("v < 1").agg(scalars.exact_sum(df.v)).collect()[0][0] == 0.3


def test_replay_stats(make_log):
    log = make_log([event("employee.created", Id="a"), event("employee.deactivated", Id="a"), event("employee.deactivated", Id="a"),
                    event("taxinfo.created", EmployeeId="a")])
    assert rows(people.replay_stats(log, event_log.events_of(log))) == [(4, 1, 2, 1)]


def test_file_formats(spark, tmp_path, make_log):
    log = make_log([event("employee.created", Id="a")])
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        log.write.format(fmt).save(path)
        assert rows(event_log.read_events(spark, path, fmt)) == rows(log)


def test_employee_info_skips_missing_fields(make_events):
    from paywright.operators.extract import employee_info_events

    log = [event("employee.created", Id="a", FirstName="A", PayRate=10, IsActive=True),
           event("employee.deactivated", Id="a", IsActive=False)]
    got = people.employee_info(employee_info_events(make_events(log))).collect()[0]
    assert (got.first_name, got.pay_rate, got.is_active, got.last_event_type) == ("A", 10.0, "false", "employee.deactivated")
    merged = people.info_from_partials(people.merge_info_partials(people.info_partials(employee_info_events(make_events(log))))).collect()[0]
    assert merged == got


def test_changelog_schema_is_stable(spark):
    empty = spark.createDataFrame([], T.StructType.fromDDL("off bigint, employee_id string, n bigint, pay double"))
    assert changelog.to_changelog(empty, ["employee_id", "n"]).columns == ["off", "key", "value"]
    assert changelog.tombstones(empty, ["employee_id", "n"], F.col("off")).columns == ["off", "key", "value"]
