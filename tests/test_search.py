import pytest
from helpers import rows

from paywright.plans import filters
from paywright.plans.search_documents import last_pay_periods, search_documents, search_hits
from paywright.schemas import EMPLOYEE_INFO, NET_PAY_VALUE
from pyspark.sql import types as T


def _net(spark, data):
    """(employee, period, net pay, pay type) rows."""
    schema = T.StructType([T.StructField("employee_id", T.StringType()), T.StructField("pay_period_number", T.LongType()),
                           *NET_PAY_VALUE.fields])
    full = [(e, p, *[0.0] * 9, n, 10.0, t, 1.0, f"2024-01-{p + 1:02d}T00:00:00", "") for e, p, n, t in data]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def documents(spark):
    info = spark.createDataFrame(
        [
            ("1", "Mary Ann", "O'Neil-Smith", "Mary.Smith@example.com", "1", 20.0, 40.0, "true", "2020-01-15T10:00:00Z", "x"),
            ("2", "Ann", "Marysdottir", "ann_x@example.com", "2", 75000.0, 40.0, "false", "2020-01-15", "x"),
            ("3", "Bob", None, "bob*@example.com", "1", None, None, None, None, "x"),
            ("4", "John", "Smith", "js@example.com", "2", 20.5, 32.0, "FALSE", "2021-03-01T00:00:00Z", "x"),
        ],
        EMPLOYEE_INFO,
    )
    net = _net(spark, [("1", p, 100.0 * p, "1") for p in range(6)] + [("4", 2, 900.0, "2"), ("9", 1, 1.0, "1")])
    return search_documents(info, net, include_inactive=True).cache()


def ids(df):
    return sorted(r["employee_id"] for r in df.select("employee_id").collect())


def simple(documents, *args):
    return ids(documents.filter(filters.compile_simple(args[0], filters.searchable_fields(documents.schema), *args[1:])))


def cond(field, operator, value, value2=""):
    return {"type": "condition", "field": field, "operator": operator, "value": value, "value2": value2}


def tree(documents, *children, operator="AND"):
    return ids(filters.search(documents, {"type": "group", "operator": operator, "children": list(children)}))


def test_documents(documents, spark):
    assert ids(documents) == ["1", "2", "3", "4"]
    r = {d.employee_id: d for d in documents.collect()}
    assert [p.pay_period_number for p in r["1"].pay_periods] == [2, 3, 4, 5]
    assert (r["2"].pay_periods, r["2"].is_active, r["3"].is_active, r["4"].is_active) == ([], False, True, False)
    assert (r["3"].last_name, r["3"].pay_rate) == ("", 0.0)


def test_inactive_are_left_out_by_default(spark):
    info = spark.createDataFrame([("1", *[None] * 6, "false", None, None), ("2", *[None] * 9)], EMPLOYEE_INFO)
    assert ids(search_documents(info, _net(spark, [("1", 0, 1.0, "1")]))) == ["2"]


def test_last_periods(spark):
    got = rows(last_pay_periods(_net(spark, [("a", p, 0.0, "1") for p in (7, 1, 3, 9, 5)])).select("pay_period_number"))
    assert sorted(got) == [(3,), (5,), (7,), (9,)]


def test_hits(documents):
    hit = search_hits(documents).filter("id = '1'").collect()[0]
    assert (hit.payType, hit.firstName, hit.payPeriods[-1].netPay) == (1, "Mary Ann", 500.0)


@pytest.mark.parametrize(
    "args,want",
    [
        (("",), ["1", "2", "3", "4"]),
        (("   ", "active"), ["1", "3"]),
        (("mary an",), ["1"]),
        (("ary",), ["1"]),
        (("arys",), []),
        (("mary",), ["1", "2"]),
        (("smith",), ["1", "4"]),
        (("o'neil",), ["1"]),
        (("MARY.SMITH",), []),  # e-mail is matched raw against the lower-cased text; two words match no single name
        (("ann_x",), ["2"]),
        (("@EXAMPLE.com",), ["1", "2", "3", "4"]),
        (("b?b*@",), ["3"]),
        (("!!!",), []),
        (("", "inactive", "2"), ["2", "4"]),
        (("smith", "inactive", "all"), ["4"]),
    ],
)
def test_simple(documents, args, want):
    assert simple(documents, *args) == want


@pytest.mark.parametrize(
    "condition,want",
    [
        (("first_name", "contains", "AN"), ["1", "2"]),
        (("first_name", "contains", "mary ann"), []),
        (("first_name", "starts_with", "an"), ["1", "2"]),
        (("first_name", "equals", "Mary Ann"), ["1"]),
        (("first_name", "equals", "mary ann"), []),
        (("email", "starts_with", "ANN"), ["2"]),
        (("email", "starts_with", "mary"), []),
        (("email", "contains", "b\\*@"), ["3"]),
        (("pay_rate", "gt", "20"), ["2", "4"]),
        (("pay_rate", "gte", " 20.0 dollars"), ["1", "2", "4"]),
        (("pay_rate", "neq", 20), ["2", "3", "4"]),
        (("pay_rate", "lt", "x"), ["1", "2", "3", "4"]),
        (("is_active", "is", "true"), ["1", "3"]),
        (("is_active", "is_not", True), ["2", "4"]),
        (("pay_type", "is_not", "1"), ["2", "4"]),
        (("hire_date", "eq", "2020-01-15"), ["1", "2"]),
        (("hire_date", "after", "2020-01-15"), ["4"]),
        (("hire_date", "after", "2020-01-15T09:00:00Z"), ["1", "4"]),
        (("hire_date", "before", "2021-03-01"), ["1", "2"]),
        (("hire_date", "between", "2020-01-01", "2021-03-01"), ["1", "2", "4"]),
        (("hire_date", "between", "2020-01-01", ""), ["1", "2", "3", "4"]),
        (("employee_id", "equals", "1"), ["1", "2", "3", "4"]),
        (("pay_periods.net_pay", "gt", "450"), ["1", "4"]),
        (("pay_periods.net_pay", "neq", "900"), ["1"]),
        (("pay_periods.pay_type", "equals", "2"), ["4"]),
        (("pay_periods.pay_period_start", "before", "2024-01-04"), ["1", "4"]),
        (("pay_periods.net_pay", "gt", "x"), ["1", "2", "3", "4"]),
    ],
)
def test_condition(documents, condition, want):
    assert tree(documents, cond(*condition)) == want


def test_groups(documents):
    inner = {"type": "group", "operator": "AND", "children": [cond("pay_type", "is", "2"), cond("is_active", "is", "false")]}
    assert tree(documents, inner, cond("first_name", "equals", "Bob"), operator="OR") == ["2", "3", "4"]
    empty = {"type": "group", "operator": "AND", "children": [cond("", "", "")]}
    assert tree(documents, empty, cond("first_name", "equals", "Bob")) == ["3"]
    # each nested condition finds its own element
    assert tree(documents, cond("pay_periods.net_pay", "eq", 200), cond("pay_periods.pay_period_number", "eq", 5)) == ["1"]


def test_page(documents):
    got = rows(filters.page(documents, 2).select("employee_id", "total_hits"))
    assert got == [("1", 4), ("2", 4)]


def test_plain_conditions_reach_the_scan(documents, spark, tmp_path):
    path = str(tmp_path / "docs")
    documents.write.parquet(path)
    found = filters.search(spark.read.parquet(path), {"operator": "AND", "children": [cond("pay_rate", "gt", "20"), cond("pay_type", "is", "2")]})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(pay_rate,20.0)" in plan and "EqualTo(pay_type,2)" in plan


@pytest.fixture(scope="module")
def records(spark):
    return spark.sql("""SELECT * FROM VALUES
        ('1', 'Mary', 20.0D, true, named_struct('net_pay', 100.0D)),
        ('2', 'mark', NULL, false, named_struct('net_pay', 300.0D)),
        ('3', 'Bob', 30.0D, true, NULL) AS t(employee_id, first_name, pay_rate, is_active, pay_attributes)""")


@pytest.mark.parametrize(
    "where,want",
    [
        ({}, ["1", "2", "3"]),
        ({"first_name": {"startsWith": "MA"}}, ["1", "2"]),
        ({"first_name": {"nstartsWith": "ma"}}, ["3"]),
        ({"first_name": {"in": ["MARY", "x"]}}, ["1"]),
        ({"first_name": {"nin": ["mary"]}}, ["2", "3"]),
        ({"pay_rate": {"neq": 20.0}}, ["2", "3"]),
        ({"pay_rate": {"eq": None}}, ["2"]),
        ({"pay_rate": {"gte": 20, "lt": 30}}, ["1"]),
        ({"pay_rate": {"in": [20.0, None]}}, ["1", "2"]),
        ({"pay_attributes": {"net_pay": {"gt": 200}}}, ["2"]),
        ({"pay_attributes": {"net_pay": {"ngt": 200}}}, ["1", "3"]),
        ({"or": [{"first_name": {"endsWith": "b"}}, {"is_active": {"eq": False}}]}, ["2", "3"]),
        ({"and": [{"first_name": {"contains": "ar"}}, {"first_name": {"ncontains": "k"}}]}, ["1"]),
    ],
)
def test_where(records, where, want):
    assert ids(records.filter(filters.compile_where(where, records.schema))) == want


def test_where_with_case(records):
    assert ids(records.filter(filters.compile_where({"first_name": {"startsWith": "Ma"}}, records.schema, ignore_case=False))) == ["1"]
