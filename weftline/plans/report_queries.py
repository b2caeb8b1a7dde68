"""The 22 reports and the vocabulary queries bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.plans import reports as R
from weftline.plans.registry import Tables, query

_1997 = [f"1997-{m:02d}" for m in range(1, 13)]
_PIVOT_SQL = ", ".join(
    f"coalesce(sum(CASE WHEN strftime(l_shipdate, '%Y-%m') = '{m}' THEN l_extendedprice::DECIMAL(18,2) END), 0)::DOUBLE"
    f" AS m{m.replace('-', '_')}"
    for m in _1997
)


@query("q01_category_sales", """
SELECT p_type, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total_sales
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= (SELECT max(l_shipdate)::DATE FROM lineitem) - 30
GROUP BY p_type ORDER BY total_sales DESC""")
def q01(t: Tables) -> DataFrame:
    return R.recent_category_sales(t.lineitem, t.part, R.days_before_latest(t.lineitem, "l_shipdate", 30))


@query("q02_frequent_customers", """
SELECT c_custkey, c_name, c_mktsegment, count(*) AS order_count
FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderdate >= (SELECT max(o_orderdate)::DATE FROM orders) - 365
GROUP BY ALL HAVING count(*) > 3 ORDER BY order_count DESC""")
def q02(t: Tables) -> DataFrame:
    since = R.days_before_latest(t.orders, "o_orderdate", 365)
    return R.frequent_customers(t.customer, t.orders, since, more_than=3)


@query("q03_running_total", """
WITH daily AS (
  SELECT r_name, o_orderdate::DATE AS order_date, sum(o_totalprice::DECIMAL(18,2)) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_name, order_date, amount::DOUBLE AS revenue,
  (sum(amount) OVER (PARTITION BY r_name ORDER BY order_date
     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS running_total
FROM daily ORDER BY r_name, order_date""")
def q03(t: Tables) -> DataFrame:
    return R.running_revenue(t.orders, t.customer, t.nation, t.region)


@query("q04_top3_per_category", """
SELECT * FROM (
  SELECT p_type, p_partkey, p_name, total_sales::DOUBLE AS total_sales,
    row_number() OVER (PARTITION BY p_type ORDER BY total_sales DESC, p_partkey) AS sales_rank
  FROM (SELECT l_partkey, sum(l_extendedprice::DECIMAL(18,2)) AS total_sales FROM lineitem GROUP BY 1)
  JOIN part ON l_partkey = p_partkey)
WHERE sales_rank <= 3 ORDER BY p_type, sales_rank""")
def q04(t: Tables) -> DataFrame:
    return R.best_sellers(t.lineitem, t.part)


@query("q05_month_pivot", f"""
SELECT s_suppkey, s_name, {_PIVOT_SQL}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE year(l_shipdate) = 1997 GROUP BY s_suppkey, s_name ORDER BY s_suppkey""")
def q05(t: Tables) -> DataFrame:
    return R.monthly_pivot(t.lineitem, t.supplier, _1997)


@query("q06_latest_record", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority
FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY orders.o_orderdate DESC, o_orderkey DESC) = 1""")
def q06(t: Tables) -> DataFrame:
    return R.latest_per_key(t.orders)


@query("q07_yoy_growth", """
WITH y AS (
  SELECT p_type, year(l_shipdate) AS fiscal_year, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
p AS (SELECT *, lag(revenue) OVER (PARTITION BY p_type ORDER BY fiscal_year) AS revenue_before FROM y)
SELECT *, CASE WHEN revenue_before <> 0 THEN (revenue - revenue_before) / revenue_before * 100 END AS growth_pct
FROM p ORDER BY p_type, fiscal_year""")
def q07(t: Tables) -> DataFrame:
    return R.yearly_growth(t.lineitem, t.part)


@query("q08_order_summary", """
SELECT o_orderkey, l_linenumber, l_suppkey, o_orderdate::DATE AS order_date, c_name, c_mktsegment, p_name, p_type,
  l_quantity, l_extendedprice AS total_amount,
  (l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS net_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey ORDER BY order_date, o_orderkey, l_linenumber""")
def q08(t: Tables) -> DataFrame:
    return R.order_summary(t.lineitem, t.orders, t.customer, t.part)


@query("q09_above_average", """
WITH a AS (
  SELECT c_mktsegment, sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(c_acctbal) AS segment_avg
  FROM customer GROUP BY 1)
SELECT c_custkey, c_name, c_mktsegment, c_acctbal, segment_avg
FROM customer JOIN a USING (c_mktsegment) WHERE c_acctbal > segment_avg""")
def q09(t: Tables) -> DataFrame:
    return R.above_group_average(t.customer)


@query("q10_status_counts", """
SELECT strftime(o_orderdate, '%Y-%m') AS order_month,
  count(*) FILTER (o_orderstatus = 'O') AS open_count,
  count(*) FILTER (o_orderstatus = 'F') AS finished_count,
  count(*) AS total_count,
  round(count(*) FILTER (o_orderstatus = 'O') / count(*) * 100, 2) AS open_pct
FROM orders GROUP BY 1 ORDER BY 1""")
def q10(t: Tables) -> DataFrame:
    return R.monthly_status_mix(t.orders)


@query("q11_explode_struct", """
WITH l AS (SELECT *, l_extendedprice::DECIMAL(18,2) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'gross' AS kind, p::DOUBLE AS amount FROM l
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'discount', (-(p * l_discount::DECIMAL(4,2)))::DOUBLE FROM l
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'tax', (p * l_tax::DECIMAL(4,2))::DOUBLE FROM l""")
def q11(t: Tables) -> DataFrame:
    return R.explode_charges(t.lineitem)


@query("q11_explode_json", """
SELECT event_id, user_id, event_type, (props->>'$.k')::INTEGER AS k FROM events""")
def q11_json(t: Tables) -> DataFrame:
    return R.explode_json(t.events)


@query("q12_moving_average", """
WITH d AS (SELECT event_type, ts::DATE AS event_date, count(*) AS event_count FROM events GROUP BY ALL)
SELECT *, round(avg(event_count) OVER (PARTITION BY event_type ORDER BY event_date
  ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS moving_avg
FROM d ORDER BY event_type, event_date""")
def q12(t: Tables) -> DataFrame:
    return R.moving_average(t.events)


@query("q13_low_stock", """
WITH pend AS (
  SELECT l_partkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q FROM lineitem
  WHERE l_linestatus = 'O' GROUP BY 1)
SELECT p_partkey, p_name, p_size * 20 AS stock, coalesce(q, 0) AS open_qty, p_size * 20 - coalesce(q, 0) AS free,
  CASE WHEN p_size * 20 - coalesce(q, 0) < 20 THEN 'LOW' ELSE 'OK' END AS alert
FROM part LEFT JOIN pend ON p_partkey = l_partkey ORDER BY free, p_partkey""")
def q13(t: Tables) -> DataFrame:
    return R.stock_alert(t.part, t.lineitem, stock_factor=20)


@query("q14_union_distinct", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority
FROM orders WHERE orders.o_orderdate >= '1995-01-01' AND orders.o_orderdate < '1997-07-01'
UNION
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority
FROM orders WHERE orders.o_orderdate >= '1997-01-01' AND orders.o_orderdate < '2000-01-01'""")
def q14(t: Tables) -> DataFrame:
    return R.union_distinct(
        R.order_slice(t.orders, "1995-01-01", "1997-07-01"), R.order_slice(t.orders, "1997-01-01", "2000-01-01")
    )


@query("q15_lifetime_value", """
WITH s AS (
  SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v, count(*) AS n,
    min(o_orderdate)::DATE AS first_order, max(o_orderdate)::DATE AS last_order
  FROM orders GROUP BY 1)
SELECT c_custkey, c_name, coalesce(v, 0) AS spend, coalesce(n, 0) AS n_orders, first_order AS since, last_order AS until,
  CASE WHEN v >= 4000000 THEN 'A' WHEN v >= 3000000 THEN 'B' WHEN v >= 1500000 THEN 'C' ELSE 'D' END AS value_tier
FROM customer LEFT JOIN s ON c_custkey = o_custkey ORDER BY spend DESC""")
def q15(t: Tables) -> DataFrame:
    return R.lifetime_value(t.customer, t.orders, (("A", 4e6), ("B", 3e6), ("C", 1.5e6)))


@query("q16_filter_sort", """
SELECT o_orderkey, o_custkey, o_orderdate::DATE AS order_date, o_totalprice FROM orders
WHERE o_orderpriority = '2-HIGH' AND o_orderdate >= '1998-01-01' ORDER BY order_date DESC, o_orderkey""")
def q16(t: Tables) -> DataFrame:
    return R.filtered_orders(t.orders, "2-HIGH", "1998-01-01")


@query("q17_daily_share", """
WITH d AS (
  SELECT o_orderdate::DATE AS order_date, o_orderpriority, sum(o_totalprice::DECIMAL(18,2)) AS a
  FROM orders GROUP BY ALL),
w AS (
  SELECT order_date, o_orderpriority, a::DOUBLE AS method_total,
    (sum(a) OVER (PARTITION BY order_date))::DOUBLE AS daily_total FROM d)
SELECT *, round(method_total / daily_total * 100, 2) AS pct_of_daily FROM w""")
def q17(t: Tables) -> DataFrame:
    return R.daily_share(t.orders)


@query("q18_segment_average", """
SELECT c_mktsegment, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS avg_order_value, count(*) AS order_count
FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1998
GROUP BY 1 ORDER BY avg_order_value DESC""")
def q18(t: Tables) -> DataFrame:
    return R.segment_order_value(t.orders, t.customer, 1998)


@query("q19_second_highest", """
SELECT p_type, p_partkey, p_name, p_retailprice FROM part
QUALIFY dense_rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) = 2
ORDER BY p_type, p_partkey""")
def q19(t: Tables) -> DataFrame:
    return R.second_highest_price(t.part)


@query("q20_cohort_retention", """
WITH f AS (SELECT o_custkey, min(date_trunc('month', o_orderdate)) AS m0 FROM orders GROUP BY 1)
SELECT strftime(m0, '%Y-%m') AS cohort_month,
  date_diff('month', m0, date_trunc('month', o_orderdate)) AS months_since_first,
  count(DISTINCT o_custkey) AS active_customers
FROM orders JOIN f USING (o_custkey) GROUP BY ALL ORDER BY 1, 2""")
def q20(t: Tables) -> DataFrame:
    return R.cohort_retention(t.orders)


@query("q21_split_name", """
SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS word_1, string_split(p_name, ' ')[2] AS word_2,
  lower(string_split(p_name, ' ')[1]) || '.' || lower(string_split(p_name, ' ')[2]) || '@example.com' AS address
FROM part""")
def q21(t: Tables) -> DataFrame:
    return R.name_addresses(t.part)


@query("q22_regional_sales", """
SELECT r_name, n_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total_amount, count(*) AS order_count,
  sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS avg_amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL ORDER BY total_amount DESC""")
def q22(t: Tables) -> DataFrame:
    return R.regional_sales(t.orders, t.customer, t.nation, t.region)


@query("v01_where", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def v01(t: Tables) -> DataFrame:
    return R.large_orders(t.orders, 400000)


@query("v02_sort", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY 1, 2 DESC, 3")
def v02(t: Tables) -> DataFrame:
    return R.customers_by_balance(t.customer)


@query("v03_limit", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def v03(t: Tables) -> DataFrame:
    return R.biggest_orders(t.orders)


@query("v04_collect_list", """
SELECT o_custkey, string_agg(y || ':' || n, ',' ORDER BY y) AS yearly_counts
FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def v04(t: Tables) -> DataFrame:
    return R.yearly_counts_list(t.orders)


@query("v05_collect_set", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
FROM orders GROUP BY 1""")
def v05(t: Tables) -> DataFrame:
    return R.priority_set(t.orders)


@query("v06_coalesce", """
SELECT c_custkey, coalesce(n, 0) AS urgent_orders FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey""")
def v06(t: Tables) -> DataFrame:
    return R.urgent_order_counts(t.customer, t.orders)
