import shutil

import pytest
from helpers import envelope, event, rows
from scenario import PERIOD, payloads, shift

from paywright.operators import projection
from paywright.plans.payroll import Payroll
from paywright.schemas import EMPLOYEE_INFO, RAW_LOG
from paywright.session import scratch_dir
from paywright.sources.changelog import table_from_changelog
from paywright.sources.event_log import events_of, read_events
from paywright.streaming import jobs
from paywright.streaming.layouts import GROSS, NET
from paywright.streaming.store import BatchStore, TieredStore, compact

KEYS = ("employee_id", "pay_period_number")


def _log():
    """Seed events in an order that spreads edits, settings and deactivations over the batches."""
    log = payloads()
    log.append(shift("w-tomas", 0, 2, "timeentry.updated"))
    log.append(event("taxinfo.updated", Id="w-tomas-tax", EmployeeId="w-tomas", FederalFilingStatus="Married", State="CA"))
    log.append(shift("w-tomas", 15, 3, "timeentry.updated"))
    log.append(event("deduction.deactivated", Id="w-tomas-ded-0", EmployeeId="w-tomas"))
    log.append(event("employee.deactivated", Id="w-lena", IsActive=False, UpdatedAt="2024-06-08T00:00:00Z"))
    log.append(event("employee.updated", Id="w-lena", PayType=2, PayRate=1, PayPeriodHours=40, UpdatedAt="2024-06-08T00:00:00Z", IsActive=True))
    log.append(event("employee.updated", Id="w-ines", FirstName="Inès", PayType=2, PayRate=80000, PayPeriodHours=40,
                     UpdatedAt="2024-05-29T00:00:00Z", IsActive=False))
    return log


@pytest.fixture(scope="module")
def log_folder(spark, tmp_path_factory):
    """The log as one JSON file per micro-batch."""
    folder = tmp_path_factory.mktemp("log")
    spark.createDataFrame([(i, envelope(p)) for i, p in enumerate(_log())], RAW_LOG)
    import json
    import os

    rows_ = [json.dumps({"off": i, "value": envelope(p)}) for i, p in enumerate(_log())]
    step = 20
    for n in range(0, len(rows_), step):
        path = folder / f"{n:05d}.json"
        path.write_text("\n".join(rows_[n : n + step]) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


def _stream(spark, folder):
    return read_events(spark, folder, "json", streaming=True, maxFilesPerTrigger=1)


def _batch(spark, folder):
    return Payroll.of(events_of(read_events(spark, folder, "json")))


def test_net_pay_and_hours_equal_their_batch_twins(spark, log_folder):
    job = jobs.NetPayStream(spark, scratch_dir(spark, "net"), current_period=PERIOD)
    query = jobs.run(_stream(spark, log_folder), job.process, scratch_dir(spark, "cp"))
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 3
    twin = _batch(spark, log_folder)
    assert rows(job.pay.hours_table(), *KEYS) == rows(twin.hours().select(*job.pay.hours_table().columns), *KEYS)
    gross = job.pay.gross_table()
    assert rows(gross, *KEYS) == rows(twin.gross_pay().select(*gross.columns), *KEYS)
    net = job.net_pay_table().drop("off")
    assert rows(net, *KEYS) == rows(twin.net_pay("asof", PERIOD).select(*net.columns), *KEYS)
    topic = job.changelog()
    assert topic.filter("value is null").count() >= 1
    assert table_from_changelog(topic, ["key"]).count() == net.count()

    # a compacted store holds the same table
    small = BatchStore(scratch_dir(spark, "compact"))
    compact(spark, job.pay.gross, small, GROSS, list(KEYS), 99)
    assert rows(small.table(spark, GROSS, list(KEYS)).drop("batch_id").select(*gross.columns), *KEYS) == rows(gross, *KEYS)


def test_replay_from_the_start_changes_nothing(spark, log_folder):
    folder = scratch_dir(spark, "replay")
    job = jobs.PayStream(spark, folder)
    cp = scratch_dir(spark, "cp")
    jobs.run(_stream(spark, log_folder), job.process, cp).awaitTermination()
    first = rows(job.gross_table(), *KEYS)
    jobs.run(_stream(spark, log_folder), job.process, cp).awaitTermination()
    assert rows(job.gross_table(), *KEYS) == first
    jobs.run(_stream(spark, log_folder), jobs.PayStream(spark, folder).process, scratch_dir(spark, "cp")).awaitTermination()
    assert rows(job.gross_table(), *KEYS) == first


def test_search_documents_equal_their_batch_twin(spark, log_folder):
    job = jobs.SearchStream(spark, scratch_dir(spark, "search"), current_period=PERIOD)
    jobs.run(_stream(spark, log_folder), job.process, scratch_dir(spark, "cp")).awaitTermination()
    from paywright.plans.search_documents import search_documents

    twin = _batch(spark, log_folder)
    want = search_documents(twin.employees(), twin.net_pay("asof", PERIOD))
    got = job.document_table()
    assert rows(got, "employee_id") == rows(want.select(*got.columns), "employee_id")
    assert "w-ines" not in {r.employee_id for r in got.collect()}


def test_employee_info_in_update_mode(spark, log_folder):
    store = BatchStore(scratch_dir(spark, "info"))
    jobs.start_employee_info(events_of(_stream(spark, log_folder)), store, scratch_dir(spark, "cp")).awaitTermination()
    got = store.table(spark, EMPLOYEE_INFO, ["employee_id"]).drop("batch_id")
    assert rows(got, "employee_id") == rows(_batch(spark, log_folder).employees().select(*got.columns), "employee_id")


def test_projection_equals_its_batch_twin(spark, tmp_path):
    import json
    import os

    log = []
    for i in range(60):
        emp, kind = f"e{i % 4}", ["created", "updated", "deactivated", "activated"][(i * 7) % 4]
        minute = (i * 37) % 50
        log.append(event(f"employee.{kind}", event_id=f"ev{i % 45}", occurred_on=f"2024-01-01T00:{minute:02d}:00Z" if i < 45 else f"2024-01-01T00:{((i % 45) * 37) % 50:02d}:00Z",
                         Id=f"e{(i % 45) % 4}" if i >= 45 else emp, FirstName=f"n{i}", PayRate=i, IsActive=True))
    for n in range(0, 60, 12):
        path = tmp_path / f"{n:03d}.json"
        path.write_text("\n".join(json.dumps({"off": n + j, "value": envelope(p)}) for j, p in enumerate(log[n : n + 12])) + "\n")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    job = jobs.ProjectionStream(spark, scratch_dir(spark, "proj"))
    jobs.run(_stream(spark, str(tmp_path)), job.process, scratch_dir(spark, "cp")).awaitTermination()
    accepted = projection.accepted_events(projection.employee_changes(events_of(read_events(spark, str(tmp_path), "json"))))
    assert rows(job.record_table(), "employee_id") == rows(projection.employee_record(accepted), "employee_id")
    assert rows(job.change_feed(), "off") == rows(projection.change_feed(accepted), "off")


def test_pay_rows_of_the_read_model(spark):
    emp = "00000000-0000-4000-8000-00000000000a"
    model = jobs.ProjectionStream(spark, scratch_dir(spark, "model"))
    mark = lambda off, kind: (off, envelope(event(f"employee.{kind}", event_id=f"v{off}", Id=emp,
                                                  occurred_on=f"2024-01-01T00:00:{off:02d}Z", FirstName="A")))
    paid = lambda off, per: (emp, per, *[1.0] * 10, 1.0, "1", 1.0, "", "", off, False)
    model.process(spark.createDataFrame([mark(2, "created")], RAW_LOG), 0)
    model.process_pay(spark.createDataFrame([paid(1, 9), paid(3, 4), paid(4, 3)], NET), 0)
    model.process_pay(spark.createDataFrame([paid(5, 4)], NET), 1)
    assert rows(model.pay_table().select("pay_period_number", "off")) == [(4, 5)]
    model.process(spark.createDataFrame([mark(6, "deactivated")], RAW_LOG), 1)
    assert model.pay_table().count() == 0
    model.process_pay(spark.createDataFrame([paid(7, 2)], NET), 2)
    assert rows(model.pay_table().select("pay_period_number", "off")) == [(2, 7)]
    assert rows(model.whole_feed(), "off") == [
        (2, emp, "created"), (3, emp, "payUpdated"), (5, emp, "payUpdated"), (6, emp, "deactivated"), (7, emp, "payUpdated")
    ]


def test_rebuild_reports_what_it_dropped(spark, log_folder):
    path = scratch_dir(spark, "rebuild")
    log = read_events(spark, log_folder, "json")
    make = lambda df: Payroll.of(events_of(df)).employees()
    assert jobs.rebuild(log, make, path) == 0
    assert jobs.rebuild(log, make, path) == 5
    shutil.rmtree(path.removeprefix("file:"))


def test_tiers_hold_every_batch_in_few_folders(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    store = TieredStore(str(tmp_path / "t"), schema, lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), fan=3)
    for batch in [*range(11), 8, 9, 10]:
        store.write(spark.createDataFrame([(batch % 2, 1), (5, batch)], schema), batch)
        if batch == 10:
            assert len(store._blocks(batch)) <= 2 * 3
            whole = store.merge(store.read(spark, batch))
            assert rows(whole, "k") == [(0, 6), (1, 5), (5, 55)]
    assert store._blocks(10) == [(2, 0), (0, 9), (0, 10)]
    assert store.read(spark, 8).count() == 3 and store.batch(spark, 4).count() == 2


@pytest.fixture
def plans(monkeypatch):
    """Plans of what the stores write, by path."""
    from paywright.streaming.store import Snapshot

    found = []
    for kind in (BatchStore, Snapshot):
        def write(self, rows, batch_id, inner=kind.write):
            found.append((self.path, rows._jdf.queryExecution().executedPlan().toString()))
            inner(self, rows, batch_id)

        monkeypatch.setattr(kind, "write", write)
    return found


def test_streams_broadcast_no_table_of_employees(spark, make_log, plans):
    search = jobs.SearchStream(spark, scratch_dir(spark, "search"), current_period=PERIOD)
    model = jobs.ProjectionStream(spark, scratch_dir(spark, "model"))
    log = make_log(_log())
    for batch_id in range(2):
        part = log.filter(f"off % 2 = {batch_id}")
        search.process(part, batch_id)
        model.process(part, batch_id)
        model.process_pay(search.net.net.read(spark, NET).filter(f"batch_id = {batch_id}").drop("batch_id"), batch_id)
    joins = [(path, line) for path, plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) > 10 and not [x for x in joins if "employee_id" in x[1]]


def test_partials_move_by_entry_only(spark, make_log, plans):
    job = jobs.PayStream(spark, scratch_dir(spark, "moves"))
    job.process(make_log(_log()), 0)
    ((_, plan),) = [x for x in plans if x[0].endswith("/pay")]
    assert "_salt" not in plan


def test_state_writes_only_what_changed():
    from paywright.streaming.keyed import _processor

    class Value(dict):
        def exists(self):
            return "v" in self

        def get(self):
            return self["v"]

        def update(self, v):
            self["v"] = v
            written.append(v)

    class Map(dict):
        iterator, containsKey, getValue = dict.items, dict.__contains__, dict.__getitem__

        def updateValue(self, k, v):
            self[k] = v
            written.append((*k, *v))

    class Handle:
        getValueState, getMapState = (lambda self, *a: Value()), (lambda self, *a: Map())

    def signal(off, **one):
        return {"off": off, "gross": None, "tax": None, "deduction": None, "gone": None, **one}

    def deduction(name, amount):
        return {"deduction_id": name, "amount": amount, "is_percentage": False, "is_active": True}

    terms = {"federal_filing_status": "Single", "state": "CA", "additional_federal_withholding": 0.0, "additional_state_withholding": 0.0}
    written, one = [], _processor(None)
    one.init(Handle())
    list(one.handleInputRows(("e",), iter([signal(1, deduction=deduction("a", 1.0)), signal(2, deduction=deduction("b", 2.0)), signal(3, tax=terms)]), None))
    written.clear()
    list(one.handleInputRows(("e",), iter([signal(4, deduction=deduction("b", 3.0)), signal(5, deduction=deduction("b", None))]), None))
    assert written == [("b", 3.0, False, True)]
    assert one.deductions == {("a",): (1.0, False, True), ("b",): (3.0, False, True)} and one.tax.get()[0] == "Single"
