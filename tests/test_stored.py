"""Laid-out data: landed logs, bucketed and published tables, lookups, indexes, intervals, state and figures."""

import json
import os
import random
import re

import pytest
from helpers import event, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from scenario import PERIOD, payloads

from paywright.functions.ranges import join_intervals
from paywright.operators import figures, netpay, people
from paywright.plans import filters
from paywright.plans.payroll import Payroll
from paywright.plans.search_index import SearchIndex, literal_runs
from paywright.session import scratch_dir
from paywright.sources.bucketed import BucketedPayroll
from paywright.sources.clustered import lookup, write_clustered
from paywright.sources.event_log import events_of, land, read_landed, with_fields
from paywright.sources.keyed_table import KeyedTable
from paywright.sources.published import POINTER, Published
from paywright.streaming import jobs, keyed
from paywright.streaming.layouts import NET
from paywright.streaming.notices import pay_notices
from paywright.streaming.store import BatchStore


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# Landed logs ---------------------------------------------------------------------------------------------------------


def test_landed_tables_never_parse_text(spark, make_log, tmp_path):
    land(make_log(payloads()), str(tmp_path / "log"))
    landed = Payroll.landed(spark, str(tmp_path / "log"))
    for table in (landed.net_pay(), landed.employees(), landed.hours(), landed.net_pay("asof", current_period=PERIOD)):
        assert not re.search("json_tuple|get_json_object|parse_json", plan_of(table))


def test_landed_members_read_like_text(spark, make_log, tmp_path):
    odd = [event("employee.created", Id="a", Email=None, IsActive=True, PayType=2, PayRate=6.25, FirstName='q"uote \\ é'), "{broken", json.dumps({"Id": "b", "Id2": {"x": [1]}})]
    raw = make_log(odd)
    land(raw, str(tmp_path / "log"))
    stored = read_landed(spark, str(tmp_path / "log"))
    names = ["Id", "Email", "IsActive", "PayType", "PayRate", "FirstName", "Id2"]
    assert rows(with_fields(stored, *names), "off") == rows(with_fields(events_of(raw), *names), "off")
    assert [r["unparsed"] for r in stored.orderBy("off").collect()] == [None, "{broken", None]


# Keyed tables --------------------------------------------------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def keyed_changes(spark, changes):
    return spark.createDataFrame(changes, "off long, k string, v long, gone boolean")


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), SCHEMA, ("k",), 8)
    assert table.read(spark).count() == 0
    first = [(i, f"k{i}", i, False) for i in range(50)]
    assert table.upsert(spark, keyed_changes(spark, first), F.col("gone")) == list(range(8))
    before = files_of(table.path)
    batch = [(100, "k7", 1, False), (101, "k7", 2, False), (102, "k9", 0, True), (103, "new", 5, False)]
    touched = table.upsert(spark, keyed_changes(spark, batch), F.col("gone"))
    assert 0 < len(touched) < 8
    changed = {f for f, m in files_of(table.path).items() if before.get(f) != m} | (before.keys() - files_of(table.path).keys())
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in changed} == set(touched)
    want = {f"k{i}": i for i in range(50) if i != 9} | {"k7": 2, "new": 5}
    assert dict(rows(table.read(spark))) == want
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ IN", plan_of(table.rows(spark, touched)))
    # Delivered again, or an older change after a newer one: nothing moves.
    table.upsert(spark, keyed_changes(spark, batch), F.col("gone"))
    table.upsert(spark, keyed_changes(spark, [(60, "k9", 77, False), (61, "k7", 77, False)]), F.col("gone"))
    assert dict(rows(table.read(spark))) == want
    assert table.upsert(spark, keyed_changes(spark, []), F.col("gone")) == []
    asked = spark.createDataFrame([("k7",), ("k9",), ("no",)], "k string")
    assert rows(table.lookup(spark, asked)) == [("k7", 2)]


def test_a_bucket_whose_keys_all_went_is_empty(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), SCHEMA, ("k",), 2)
    table.upsert(spark, keyed_changes(spark, [(i, f"k{i}", i, False) for i in range(6)]), F.col("gone"))
    table.upsert(spark, keyed_changes(spark, [(10 + i, f"k{i}", i, True) for i in range(6)]), F.col("gone"))
    assert table.read(spark).count() == 0 and table.rows(spark).count() == 6


# Published versions --------------------------------------------------------------------------------------------------


def test_a_failed_rebuild_leaves_the_old_table(spark, make_events, tmp_path):
    path = str(tmp_path / "p")
    log = make_events(payloads())
    make = lambda events: Payroll.of(events).employees()
    assert Published(path).read(spark) is None and jobs.rebuild(log, make, path) == 0
    old = Published(path).current(spark)
    fails = lambda events: make(events).withColumn("x", F.when(F.col("employee_id").isNotNull(), F.raise_error(F.lit("stop"))))
    with pytest.raises(Exception, match="stop"):
        jobs.rebuild(log, fails, path)
    assert Published(path).current(spark) == old and Published(path).read(spark).count() == 5
    pinned = Published(path).read(spark, old)
    assert jobs.rebuild(log.filter("off < 2"), make, path) == 5
    assert Published(path).read(spark).count() == 2 and pinned.count() == 5
    assert os.path.isfile(f"{path}/{POINTER}")


# Lookups -------------------------------------------------------------------------------------------------------------


def scanned_rows(df):
    """Rows that came out of the scan, by its own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_lookups_read_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    many = spark.range(60_000).select(F.concat(F.lit("key"), F.xxhash64(F.col("id") % 20_000).cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    many = many.unionByName(spark.range(30_000).select(F.lit("hot").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    path = str(tmp_path / "t")
    write_clustered(many, path, "k", 2000, partitions=3, row_group_bytes=1 << 18)
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in files_of(path) for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 12 and max(g.num_rows for g in groups) < 15_000
    key = many.where("k <> 'hot'").first()["k"]
    found = lookup(spark, path, "k", [key])
    assert found.count() == 3 and scanned_rows(lookup(spark, path, "k", [key])) <= 2 * max(g.num_rows for g in groups)
    assert scanned_rows(lookup(spark, path, "k", ["key1", "key2"])) <= max(g.num_rows for g in groups)
    assert lookup(spark, path, "k", ["hot"]).count() == 30_000


# Index ---------------------------------------------------------------------------------------------------------------

DOCS = "employee_id string, first_name string, last_name string, email string, note string, pay_type string, is_active boolean"


def docs_for_index(spark, n=150):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Mary", "Ann", "mary-ann", "O'Neil", "a", "Al", "3.5", "x_y", "Ünal", "李"])
    text = lambda: rnd.choice([None, "", " ".join(word() for _ in range(rnd.randint(1, 4)))])
    mail = lambda i: rnd.choice([None, "", f"{word()}.{i}@ex*mple.com".lower(), "ab", "a"])
    return spark.createDataFrame([(f"e{i}", text(), text(), mail(i), mail(i), rnd.choice("12"), rnd.random() < 0.5) for i in range(n)], DOCS)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = docs_for_index(spark).cache()
    index = SearchIndex(str(tmp_path / "i"), docs.schema, buckets=4)
    index.build(docs)
    fields = filters.searchable_fields(docs.schema)
    for text in ["", " ", "mary", "Mary A", "ann al", "a", "o'neil", "3.5", "3", "ünal", "李", "ary", "ab", "@ex", ".1", "m*m", "e?.", "*", "zz", "a a a", "\\*m", "y-a", "x_y a"]:
        for status, kind in (("all", "all"), ("active", "1")):
            want = {r[0] for r in docs.filter(filters.compile_simple(text, fields, status, kind)).select("employee_id").collect()}
            got = [r[0] for r in index.simple(spark, text, status, kind).select("employee_id").collect()]
            assert set(got) == want and len(got) == len(want), text
    assert index.simple(spark, "mary").columns == docs.columns


def test_index_reads_shelves_of_the_asked_words(spark, tmp_path):
    docs = docs_for_index(spark)
    index = SearchIndex(str(tmp_path / "i"), docs.schema, buckets=4)
    index.build(docs)
    for found in (index.phrase(spark, "mary ann"), index.substring(spark, "mary")):
        plan = plan_of(found)
        scans = re.findall(r"FileScan.*", plan)
        assert scans and all(re.search(r"PartitionFilters: \[[^]]*shelf#\d+ = \d+", scan) for scan in scans)
    assert "StringStartsWith(token,ann)" in plan_of(index.phrase(spark, "mary ann"))
    assert index.phrase(spark, " ,") is None and index.substring(spark, "**") is None
    assert literal_runs(r"a*b\*c?\\d") == ["a", "b*c", "\\d"]


# Bucketed joins ------------------------------------------------------------------------------------------------------


def test_bucketed_joins_exchange_nothing(spark, make_events):
    plain = Payroll.of(make_events(payloads()))
    tables = BucketedPayroll.write(plain, spark, 4)
    got = tables.net_pay(spark)
    key = ("employee_id", "pay_period_number")
    assert rows(got, *key) == rows(plain.net_pay(), *key)
    plan = plan_of(tables.net_pay(spark))
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan


# Intervals -----------------------------------------------------------------------------------------------------------


def test_points_meet_their_intervals(spark):
    rnd = random.Random(1)
    points = [(i, rnd.choice("ab"), rnd.choice([rnd.uniform(-50, 500), float(rnd.randint(-5, 20)), None])) for i in range(300)] + [(300, None, 1.0)]
    edges = [("a", -10.0, 0.0), ("a", 0.0, 0.5), ("a", 3.0, 3.0), ("a", 5.0, 2.0), ("a", 7.0, None), ("b", -1e6, 1e6), ("b", 1.0, 2.0), (None, 0.0, 9.0), ("a", None, 9.0)]
    edges += [(rnd.choice("ab"), a, a + rnd.choice([0.01, 1, 3, 16, 64, 100.5])) for a in (rnd.uniform(-20, 100) for _ in range(60))]
    p = spark.createDataFrame(points, "id long, g string, v double")
    i = spark.createDataFrame([(n, *e) for n, e in enumerate(edges)], "iv long, g string, low double, high double")
    met = join_intervals(p, i, ["g"], "v", "low", "high", "id")
    want = sorted((pid, n) for pid, g, v in points for n, (h, a, b) in enumerate(edges) if g == h and None not in (g, v, a) and a <= v and (b is None or v < b))
    assert sorted((r["id"], r["iv"]) for r in met.collect()) == want
    plan = plan_of(met)
    assert "SortMergeJoin" in plan and not re.search("NestedLoop|Cartesian|BroadcastHashJoin", plan)


# Keyed state ---------------------------------------------------------------------------------------------------------


def test_state_equals_the_batch_and_can_be_read(spark, make_log, make_events, tmp_path):
    log = payloads()
    log.insert(60, event("taxinfo.updated", Id="t", EmployeeId="w-tomas", FederalFilingStatus="Married", State="CA"))
    log += [event("deduction.deactivated", Id="w-ines-ded-0", EmployeeId="w-ines"), event("employee.deactivated", Id="w-lena")]
    signals, net, states = keyed.SignalStream(spark, str(tmp_path / "s")), BatchStore(str(tmp_path / "net")), str(tmp_path / "states")
    parts = 3
    for part in range(parts):
        cut = make_log(log).filter((F.col("off") * parts / len(log)).cast("int") == part)
        signals.process(cut, part)
        keyed.start_states(spark, signals, net, states, current_period=PERIOD).awaitTermination()
    key = ["employee_id", "pay_period_number"]
    want = Payroll.of(make_events(log)).net_pay("asof", current_period=PERIOD).drop("last_off", "emitted_off")
    assert rows(net.table(spark, NET, key).drop("batch_id", "off").select(*want.columns), *key) == rows(want, *key)
    hot = spark.read.parquet(f"{signals.signals.path}/*").groupBy("employee_id").count().agg(F.max("count")).first()[0]
    assert hot < len(log) / 2
    tax = spark.read.format("statestore").option("stateVarName", "tax").load(states)
    held = {r["key"]["employee_id"]: r["value"]["state"] for r in tax.collect()}
    assert held["w-tomas"] == Payroll.of(make_events(log)).tax_state().filter("employee_id = 'w-tomas'").first()["state"]


def test_signals_are_reduced_on_the_way(make_events):
    log = [event("deduction.updated", Id="d", EmployeeId="e", Amount=i, IsPercentage=False, IsActive=True) for i in range(50)]
    events = make_events(log)
    gross = Payroll.of(events).gross_pay()
    found = keyed.signals(events, gross).collect()
    assert len(found) == 1 and found[0]["deduction"]["amount"] == 49.0


# Figures and notices -------------------------------------------------------------------------------------------------


def test_page_counts_on_the_way(spark):
    docs = spark.range(500).select(F.format_string("e%03d", "id").alias("employee_id"))
    page = figures.page_in_one_pass(docs, 20).collect()
    assert [r["employee_id"] for r in page] == [f"e{i:03d}" for i in range(20)] and {r["total_hits"] for r in page} == {500}
    assert figures.page_in_one_pass(docs.limit(0)).collect() == []


def test_observed_replay_figures(make_events, make_log):
    log = [event("employee.created", Id="a"), event("employee.deactivated", Id="a"), event("employee.deactivated", Id="a"), event("taxinfo.created", Id="t")]
    from pyspark.sql import Observation

    seen = Observation()
    named = figures.named_records(make_events(log))
    named.observe(seen, *[c.alias(n) for n, c in figures.replay_figures().items()]).write.format("noop").mode("overwrite").save()
    want = people.replay_stats(make_log(log), make_events(log)).first().asDict()
    assert seen.get == {k: want[k] for k in ("total_records", "created", "deactivated")}


def test_notices_wait_for_either_side(spark, tmp_path):
    pay, known = str(tmp_path / "pay"), str(tmp_path / "known")
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    write = lambda path, data, schema: spark.createDataFrame(data, schema).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(path)
    out = []
    steps = [([(1, "a", day(5)), (2, "b", day(5)), (3, "c", day(5))], [("a", day(3))]), ([(4, "a", day(6))], [("b", day(6)), ("a", day(6))]), ([(5, "c", day(20))], [("c", day(20)), ("b", day(20))])]
    for rows_, records in steps:
        write(pay, rows_, "off long, employee_id string, at string")
        write(known, records, "employee_id string, at string")
        left = spark.readStream.schema("off long, employee_id string, at timestamp").parquet(pay)
        right = spark.readStream.schema("employee_id string, at timestamp").parquet(known)
        notices = pay_notices(left, right, "4 DAYS", "2 DAYS", salts=2)
        jobs.run(notices, lambda batch, i: out.extend(r["off"] for r in batch.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(out) == [1, 2, 4, 5]


def test_landed_identity_joins_without_broadcast(spark, tmp_path):
    from paywright.driver import stored_queries

    made = spark.range(40).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2024-01-02 03:04:05' AS ts", "id % 4 AS user_id",
        "element_at(array('click', 'view', 'signup', 'purchase', 'error'), CAST(id % 5 + 1 AS INT)) AS event_type",
        "1.5D AS value", "concat('{\"k\": ', id, '}') AS props",
    )
    made.write.parquet(f"{tmp_path}/events.parquet")
    found = stored_queries.landed_identity_forms(spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 40
