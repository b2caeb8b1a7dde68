"""Edges of the reports that the test tables do not contain."""

import datetime

from pyspark.sql import functions as F

from weftline.operators import dataset as D
from weftline.plans import reports as R


def test_one_word_names_give_null(spark):
    df = spark.createDataFrame([(1, "Ada Lovelace"), (2, "Plato"), (3, "")], "p_partkey bigint, p_name string")
    rows = R.name_addresses(df).orderBy("p_partkey").collect()
    assert [(r.word_1, r.word_2, r.address) for r in rows] == [
        ("Ada", "Lovelace", "ada.lovelace@example.com"), ("Plato", None, None), ("", None, None)]


LINE = "l_orderkey bigint, l_partkey bigint, l_extendedprice double, l_quantity double, l_linestatus string, l_shipdate timestamp_ntz"
PART = "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double"


def lines(spark, rows):
    return spark.createDataFrame(
        [(1, key, price, 4.0, "O", datetime.datetime.fromisoformat(day)) for key, price, day in rows], LINE)


def parts(spark, rows):
    return spark.createDataFrame(rows, PART)


def test_growth_over_nothing_is_null(spark):
    df = lines(spark, [(1, 0.0, "2020-01-05"), (1, 5.0, "2021-03-01"), (1, 2.5, "2022-03-01"), (1, 2.5, "2022-04-01")])
    rows = R.yearly_growth(df, parts(spark, [(1, "n", "T", 1, 1.0)])).collect()
    assert [(r.fiscal_year, r.growth_pct) for r in rows] == [(2020, None), (2021, None), (2022, 0.0)]


def test_ties_for_second_place_are_kept(spark):
    df = parts(spark, [(1, "a", "T", 1, 9.0), (2, "b", "T", 1, 9.0), (3, "c", "T", 1, 8.0), (4, "d", "T", 1, 8.0),
                       (5, "e", "T", 1, 7.0), (6, "f", "U", 1, 1.0)])
    assert [r.p_partkey for r in R.second_highest_price(df).collect()] == [3, 4]


def test_days_without_revenue(spark):
    day = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, 0.0, day, "x"), (2, 0.0, day, "y")],
                               "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    assert [r.pct_of_daily for r in R.daily_share(df).collect()] == [None, None]


def test_reports_count_back_from_today_by_default(spark):
    today = datetime.date.today()
    days = [today - datetime.timedelta(days=n) for n in (1, 29, 60, 400)]
    df = lines(spark, [(1, 10.0, d.isoformat()) for d in days])
    part = parts(spark, [(1, "n", "T", 10, 1.0), (2, "m", "T", 30, 1.0)])
    assert R.recent_category_sales(df, part).first().total_sales == 20.0
    stock = {r.p_partkey: (r.open_qty, r.alert) for r in R.stock_alert(part, df, R.days_ago(90)).collect()}
    assert stock == {1: (12.0, "LOW"), 2: (0.0, "OK")}


def test_tiers_by_spend_and_customers_without_orders(spark):
    day = datetime.datetime(2020, 1, 1)
    orders = spark.createDataFrame([(1, 1, 600.0, day), (2, 1, 400.0, day + datetime.timedelta(days=9)), (3, 2, 999.99, day)],
                                   "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz")
    customer = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_custkey bigint, c_name string")
    rows = {r.c_custkey: (r.spend, r.n_orders, r.until, r.value_tier) for r in R.lifetime_value(customer, orders).collect()}
    assert rows == {1: (1000.0, 2, datetime.date(2020, 1, 10), "C"), 2: (999.99, 1, datetime.date(2020, 1, 1), "D"), 3: (0.0, 0, None, "D")}


def test_union_is_by_position(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "other int, name string")
    assert sorted(map(tuple, R.union_distinct(a, b).collect())) == [(1, "x"), (2, "y")]


def test_ties_in_statistics_go_to_the_first_seen(spark):
    df = spark.createDataFrame(
        [(3, "b", ["z", "y"]), (1, "a", ["y", "z"]), (2, "c", ["q"])],
        "line_num bigint, complexity string, operations array<string>")
    assert [r.complexity for r in D.complexity_histogram(df).collect()] == ["a", "c", "b"]
    assert [tuple(r) for r in D.top_operations(df).collect()] == [("y", 2), ("z", 2), ("q", 1)]
    assert [tuple(r) for r in D.top_operations(df, n=1).collect()] == [("y", 2)]


def test_unknown_tables(spark):
    df = spark.createDataFrame([('spark.table("a.b").join(spark.table(\'c.d\'))',), ('spark.table("a.b")',), ("none",)],
                               "code string")
    known = spark.createDataFrame([("c.d",)], "table_name string")
    assert [tuple(r) for r in D.unknown_tables(df, known).collect()] == [("a.b", 2)]


def test_sequence_budget_tiers(spark):
    df = spark.createDataFrame([("w " * 1100, ""), ("w", "")], "description string, code string")
    rows = {r.memory_gb: (r.max_tokens, r.over_budget, r.over_share) for r in D.sequence_budget(df).collect()}
    assert rows[0] == (1024, 1, 0.5) and rows[16] == (1536, 0, 0.0) and len(rows) == 5


def test_open_requests_count_but_have_no_lead_time(spark):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, at + datetime.timedelta(seconds=90), True), (at, None, False)],
                               "requested_at timestamp_ntz, delivered_at timestamp_ntz, accepted boolean")
    row = D.request_outcomes(df, F.date_format("requested_at", "yyyy")).first()
    assert (row.requests, row.acceptance_rate, row.mean_lead_seconds, row.on_target) == (2, 0.5, 90.0, False)
