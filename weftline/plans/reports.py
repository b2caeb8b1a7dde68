"""Parameterised business reports.

Each report takes its input tables and parameters and returns a lazy DataFrame.
House rules, so that the plans hold at cluster scale:

* money is summed as DECIMAL and turned into DOUBLE last, which makes totals
  independent of task order;
* facts are aggregated to their report grain before any join or window, so one
  hot key arrives at the shuffle as a handful of partial rows;
* window partitions hold pre-aggregated rows (bounded by the calendar or by a
  pruned rank), never the raw rows of one key;
* only the fixed-size nation and region lookups are broadcast by hint: for any other side
  the optimizer decides by measured size, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.skew import salted_by_count, salted_join

MONEY = "decimal(18,2)"


def money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def hundredths(name: str) -> Column:
    """A two-decimal amount as whole hundredths: row arithmetic on these is exact and fast."""
    return F.rint(F.col(name) * 100).cast("bigint")


def net_amount() -> Column:
    """Extended price after discount, exact to four decimals."""
    return hundredths("l_extendedprice") * (F.lit(100) - hundredths("l_discount")) / F.lit(10000.0)


def total(amount: Column | str) -> Column:
    return F.sum(money(amount) if isinstance(amount, str) else amount).cast("double")


def mean(amount: str) -> Column:
    """Average over an exact total (a DECIMAL average would round to its own scale)."""
    return total(amount) / F.count(amount)


def days_ago(days: int) -> Column:
    return F.date_sub(F.current_date(), days)


def days_before_latest(df: DataFrame, column: str, days: int) -> Column:
    """``days`` before the newest day of a table, as a scalar subquery of the column's own type.

    A bare ``column >= subquery`` reaches the scan as a pushed filter once the subquery has run.
    """
    newest_day = F.date_sub(F.max(column).cast("date"), days)
    return df.select(newest_day.cast(df.schema[column].dataType).alias("since")).scalar()


def month_number(column: str) -> Column:
    return F.year(column) * 12 + F.month(column) - 1


def month_label(number: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"))


# -- totals and rankings ----------------------------------------------------------------


def recent_category_sales(lineitem: DataFrame, part: DataFrame, since: Column | None = None) -> DataFrame:
    """Sales per part type since a day (30 days ago when not given), largest first."""
    since = days_ago(30) if since is None else since
    per_part = (
        lineitem.filter(F.col("l_shipdate") >= since)
        .groupBy("l_partkey")
        .agg(F.sum(money("l_extendedprice")).alias("amount"))
    )
    return (
        per_part.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_type")
        .agg(total(F.col("amount")).alias("total_sales"))
        .orderBy(F.desc("total_sales"))
    )


def frequent_customers(
    customer: DataFrame, orders: DataFrame, since: Column | None = None, more_than: int = 5
) -> DataFrame:
    """Customers with more than ``more_than`` orders since a day (90 days ago when not given).

    Orders are counted, and the threshold applied, before the join.
    """
    since = days_ago(90) if since is None else since
    counts = (
        orders.filter(F.col("o_orderdate") >= since)
        .groupBy("o_custkey")
        .agg(F.count("*").alias("order_count"))
        .filter(F.col("order_count") > more_than)
    )
    return (
        customer.join(counts, customer["c_custkey"] == counts["o_custkey"])
        .select("c_custkey", "c_name", "c_mktsegment", "order_count")
        .orderBy(F.desc("order_count"), "c_custkey")
    )


def running_revenue(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Daily revenue per region with its running total.

    Orders are added up per customer and day before the join, so a customer with very many of them meets it as
    one row a day; then per region and day before the window, which so holds one row per day.
    ``nation`` and ``region`` are fixed-size lookups (25 and 5 rows at every scale).
    """
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    per_customer = orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("order_date")).agg(
        F.sum(money("o_totalprice")).alias("spent")
    )
    daily = (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "order_date")
        .agg(F.sum("spent").alias("amount"))
    )
    so_far = (
        Window.partitionBy("r_name").orderBy("order_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        daily.withColumn("running_total", F.sum("amount").over(so_far).cast("double"))
        .withColumn("revenue", F.col("amount").cast("double"))
        .select("r_name", "order_date", "revenue", "running_total")
        .orderBy("r_name", "order_date")
    )


def best_sellers(lineitem: DataFrame, part: DataFrame, n: int = 3) -> DataFrame:
    """Top ``n`` parts by sales in each type (the rank filter prunes before the shuffle)."""
    sales = lineitem.groupBy("l_partkey").agg(F.sum(money("l_extendedprice")).alias("total_sales"))
    by_sales = Window.partitionBy("p_type").orderBy(F.desc("total_sales"), F.asc("p_partkey"))
    return (
        sales.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "p_type", "p_partkey", "p_name", "total_sales", F.row_number().over(by_sales).alias("sales_rank")
        )
        .filter(F.col("sales_rank") <= n)
        .withColumn("total_sales", F.col("total_sales").cast("double"))
        .orderBy("p_type", "sales_rank")
    )


def monthly_pivot(lineitem: DataFrame, supplier: DataFrame, months: Sequence[str]) -> DataFrame:
    """Sales per supplier with one column per month, 0 where there were none.

    The months are given, so Spark needs no extra pass to discover pivot values, and
    the scan reads only their range.
    """
    start = F.to_date(F.lit(min(months)), "yyyy-MM")
    end = F.add_months(F.to_date(F.lit(max(months)), "yyyy-MM"), 1)
    per_supplier = (
        lineitem.filter((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end))
        .withColumn("ship_month", F.date_format("l_shipdate", "yyyy-MM"))
        .groupBy("l_suppkey")
        .pivot("ship_month", list(months))
        .agg(total("l_extendedprice"))
    )
    return (
        supplier.select("s_suppkey", "s_name")
        .join(per_supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .drop("l_suppkey")
        .select("s_suppkey", "s_name", *[F.col(f"`{m}`").alias("m" + m.replace("-", "_")) for m in months])
        .fillna(0, subset=["m" + m.replace("-", "_") for m in months])
        .orderBy("s_suppkey")
    )


def latest_per_key(orders: DataFrame) -> DataFrame:
    """The most recent order of each customer; ties go to the higher order key.

    Rank 1 is pruned inside each input partition first, so a hot customer sends one
    row per task.
    """
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return (
        orders.withColumn("row_num", F.row_number().over(newest))
        .filter(F.col("row_num") == 1)
        .drop("row_num")
        .withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    )


def yearly_growth(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Revenue per part type and year, with growth over the year before in percent."""
    per_part = lineitem.groupBy("l_partkey", F.year("l_shipdate").alias("fiscal_year")).agg(
        F.sum(money("l_extendedprice")).alias("amount")
    )
    yearly = (
        per_part.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_type", "fiscal_year")
        .agg(total(F.col("amount")).alias("revenue"))
    )
    before = F.lag("revenue").over(Window.partitionBy("p_type").orderBy("fiscal_year"))
    growth = F.try_divide(F.col("revenue") - before, before) * 100
    return yearly.select("*", before.alias("revenue_before"), growth.alias("growth_pct")).orderBy("p_type", "fiscal_year")


def order_summary(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    """Order lines with customer and part details and the line amount.

    Customers of very many orders, and parts of very many lines, are counted first, and their rows are dealt over as many tasks as their share asks for.
    """
    lines = lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("p_partkey"),
        "l_suppkey", "l_linenumber", "l_quantity",
        F.col("l_extendedprice").alias("total_amount"),
        net_amount().alias("net_amount"),
    )
    heads = orders.select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("order_date")
    )
    heads = salted_by_count(heads, customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", ["o_orderkey"])
    lines = salted_by_count(lines, part.select("p_partkey", "p_name", "p_type"), "p_partkey", ["o_orderkey", "l_linenumber"])
    return (
        lines.join(heads, "o_orderkey")
        .select(
            "o_orderkey", "l_linenumber", "l_suppkey", "order_date", "c_name", "c_mktsegment",
            "p_name", "p_type", "l_quantity", "total_amount", "net_amount",
        )
        .orderBy("order_date", "o_orderkey", "l_linenumber")
    )


def above_group_average(customer: DataFrame) -> DataFrame:
    """Customers whose balance is above their segment's average.

    The average is a partial aggregation joined back with salt, so no task ever holds a
    whole segment the way a whole-partition window would.
    """
    averages = customer.groupBy("c_mktsegment").agg(mean("c_acctbal").alias("segment_avg"))
    return (
        salted_join(customer, averages, ["c_mktsegment"], spread_by=["c_custkey"])
        .filter(F.col("c_acctbal") > F.col("segment_avg"))
        .select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "segment_avg")
        .orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")
    )


def monthly_status_mix(orders: DataFrame) -> DataFrame:
    """Open, finished and total orders per month, and the open share in percent."""
    return (
        orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("order_month"))
        .agg(
            F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open_count"),
            F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished_count"),
            F.count("*").alias("total_count"),
        )
        .withColumn(
            "open_pct", F.round(F.try_divide(F.col("open_count"), F.col("total_count")) * 100, 2)
        )
        .orderBy("order_month")
    )


# -- nested data --------------------------------------------------------------------------


def explode_charges(lineitem: DataFrame) -> DataFrame:
    """Unnest an array of (kind, amount) structs: gross price, discount and tax of a line."""
    price = hundredths("l_extendedprice")

    def charge(kind: str, ten_thousandths: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (ten_thousandths / F.lit(10000.0)).alias("amount"))

    nested = lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array(
            charge("gross", price * 100),
            charge("discount", -price * hundredths("l_discount")),
            charge("tax", price * hundredths("l_tax")),
        ).alias("charges"),
    )
    return nested.withColumn("charge", F.explode("charges")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("charge.kind").alias("kind"), F.col("charge.amount").alias("amount"),
    )


def explode_json(events: DataFrame) -> DataFrame:
    """Parse a JSON array column, unnest it and read its fields."""
    return (
        events.withColumn("items", F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k:int>>"))
        .withColumn("item", F.explode("items"))
        .select("event_id", "user_id", "event_type", F.col("item.k").alias("k"))
    )


def moving_average(events: DataFrame, rows: int = 7) -> DataFrame:
    """Daily event count per type with its moving average over ``rows`` daily rows."""
    daily = events.groupBy("event_type", F.col("ts").cast("date").alias("event_date")).agg(
        F.count("*").alias("event_count")
    )
    frame = Window.partitionBy("event_type").orderBy("event_date").rowsBetween(1 - rows, 0)
    return daily.withColumn("moving_avg", F.round(F.avg("event_count").over(frame), 2)).orderBy(
        "event_type", "event_date"
    )


# -- enrichment -----------------------------------------------------------------------------


def stock_alert(
    part: DataFrame, lineitem: DataFrame, since: Column | None = None,
    stock_factor: int = 2, reorder_point: int = 20,
) -> DataFrame:
    """Stock less what open lines (of all days, or from ``since`` on) will take, LOW below the reorder point."""
    still_open = F.col("l_linestatus") == "O"
    if since is not None:
        still_open &= F.col("l_shipdate") >= since
    taken = lineitem.filter(still_open).groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        total("l_quantity").alias("open_qty")
    )
    stock, pending = F.col("p_size") * stock_factor, F.coalesce("open_qty", F.lit(0.0))
    return part.join(taken, "p_partkey", "left").select(
        "p_partkey", "p_name", stock.alias("stock"), pending.alias("open_qty"), (stock - pending).alias("free"),
        F.when(stock - pending < reorder_point, "LOW").otherwise("OK").alias("alert"),
    ).orderBy("free", "p_partkey")


def union_distinct(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of either input, by position, without duplicates."""
    return first.union(second).distinct()


def order_slice(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Orders with ``start`` <= date < ``end``."""
    day = F.col("o_orderdate")
    return orders.filter((day >= F.to_date(F.lit(start))) & (day < F.to_date(F.lit(end)))).withColumn(
        "o_orderdate", day.cast("date")
    )


# Names of value tiers with the least spend of each, highest first; who reaches none is in REST_TIER.
VALUE_TIERS = (("A", 10000.0), ("B", 5000.0), ("C", 1000.0))
REST_TIER = "D"


def lifetime_value(
    customer: DataFrame, orders: DataFrame, tiers: Sequence[tuple[str, float]] = VALUE_TIERS, rest: str = REST_TIER
) -> DataFrame:
    """Spend, number of orders and their first and last day for every customer, with the tier that the spend reaches."""
    bought = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), total("o_totalprice").alias("sum"),
        F.min("o_orderdate").alias("since"), F.max("o_orderdate").alias("until"),
    )
    spent = F.coalesce("sum", F.lit(0.0))
    reached = [F.when(spent >= least, name) for name, least in tiers]
    return customer.join(bought, "c_custkey", "left").select(
        "c_custkey", "c_name", spent.alias("spend"), F.coalesce("n", F.lit(0)).alias("n_orders"),
        F.to_date("since").alias("since"), F.to_date("until").alias("until"),
        F.coalesce(*reached, F.lit(rest)).alias("value_tier"),
    ).orderBy(F.desc("spend"), "c_custkey")


def filtered_orders(orders: DataFrame, priority: str, since: str) -> DataFrame:
    """Orders of one priority since a day, newest first."""
    return (
        orders.filter((F.col("o_orderpriority") == priority) & (F.col("o_orderdate") >= since))
        .select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"), "o_totalprice")
        .orderBy(F.desc("order_date"), "o_orderkey")
    )


def daily_share(orders: DataFrame) -> DataFrame:
    """Each priority's share of the day's revenue in percent."""
    daily = orders.groupBy(F.col("o_orderdate").cast("date").alias("order_date"), "o_orderpriority").agg(
        F.sum(money("o_totalprice")).alias("amount")
    )
    day_total = F.sum("amount").over(Window.partitionBy("order_date")).cast("double")
    amount = F.col("amount").cast("double")
    return (
        daily.select(
            "order_date", "o_orderpriority", amount.alias("method_total"), day_total.alias("daily_total"),
        )
        .withColumn("pct_of_daily", F.round(F.try_divide(F.col("method_total"), F.col("daily_total")) * 100, 2))
        .orderBy("order_date", F.desc("method_total"))
    )


def segment_order_value(orders: DataFrame, customer: DataFrame, year: int) -> DataFrame:
    """Average order value and order count per segment for one year.

    The year filter is a date range, which reaches the scan; ``year(col) = n`` would not.
    """
    start, end = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + 1}-01-01").cast("date")
    per_customer = (
        orders.filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
        .groupBy("o_custkey")
        .agg(F.sum(money("o_totalprice")).alias("amount"), F.count("o_orderkey").alias("n"))
    )
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(
            (total(F.col("amount")) / F.sum("n")).alias("avg_order_value"),
            F.sum("n").alias("order_count"),
        )
        .orderBy(F.desc("avg_order_value"))
    )


def second_highest_price(part: DataFrame) -> DataFrame:
    """Parts with the second highest price of their type, ties kept.

    Distinct prices are ranked (not parts), then joined back with salt: ties spread over tasks.
    """
    by_price = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"))
    second = (
        part.select("p_type", "p_retailprice").distinct()
        .withColumn("price_rank", F.row_number().over(by_price))
        .filter(F.col("price_rank") == 2)
        .drop("price_rank")
    )
    return (
        salted_join(part, second, ["p_type", "p_retailprice"], spread_by=["p_partkey"])
        .select("p_type", "p_partkey", "p_name", "p_retailprice")
        .orderBy("p_type", "p_partkey")
    )


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Active customers per first-order month and months since.

    A customer's distinct active months are bounded by the calendar, so the window over them
    stays small for a customer with any number of orders. Each (customer, month) is one row,
    which makes the distinct count a plain count.
    """
    active = orders.select("o_custkey", month_number("o_orderdate").alias("month")).distinct()
    return (
        active.withColumn("first_month", F.min("month").over(Window.partitionBy("o_custkey")))
        .groupBy("first_month", (F.col("month") - F.col("first_month")).alias("months_since_first"))
        .agg(F.count("*").alias("active_customers"))
        .select(month_label(F.col("first_month")).alias("cohort_month"), "months_since_first", "active_customers")
        .orderBy("cohort_month", "months_since_first")
    )


def name_addresses(part: DataFrame, domain: str = "example.com") -> DataFrame:
    """The first two words of a name, and an address of the form first.second@domain; null where there is no second word."""
    two = F.slice(F.split("p_name", " "), 1, 2)
    address = F.when(F.size(two) == 2, F.lower(F.array_join(two, ".")))
    return part.select(
        "p_partkey", "p_name", F.get(two, F.lit(0)).alias("word_1"), F.get(two, F.lit(1)).alias("word_2"),
        F.concat(address, F.lit(f"@{domain}")).alias("address"),
    )


def regional_sales(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    """Order total, count and average per region and nation.

    ``nation`` and ``region`` are fixed-size lookups (25 and 5 rows at every scale);
    orders are pre-aggregated per customer.
    """
    places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    per_customer = orders.groupBy("o_custkey").agg(
        F.sum(money("o_totalprice")).alias("amount"), F.count("o_orderkey").alias("n")
    )
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name")
        .agg(
            total(F.col("amount")).alias("total_amount"),
            F.sum("n").alias("order_count"),
            (total(F.col("amount")) / F.sum("n")).alias("avg_amount"),
        )
        .orderBy(F.desc("total_amount"))
    )


# -- vocabulary not used by the reports above --------------------------------------------------


def large_orders(orders: DataFrame, above: float) -> DataFrame:
    return orders.where(F.col("o_totalprice") > above).select("o_orderkey", "o_custkey", "o_totalprice")


def customers_by_balance(customer: DataFrame) -> DataFrame:
    """Customers sorted by segment, then balance downwards."""
    return customer.select("c_mktsegment", "c_acctbal", "c_custkey").sort(
        F.asc("c_mktsegment"), F.desc("c_acctbal"), F.asc("c_custkey")
    )


def biggest_orders(orders: DataFrame, n: int = 10) -> DataFrame:
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(n).select("o_orderkey", "o_totalprice")


def yearly_counts_list(orders: DataFrame) -> DataFrame:
    """Yearly order counts of each customer as one list.

    Counting first bounds each list by the number of years, whatever a customer ordered.
    """
    yearly = orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return (
        yearly.groupBy("o_custkey")
        .agg(F.array_sort(F.collect_list(F.concat_ws(":", "y", "n"))).alias("years"))
        .select("o_custkey", F.array_join("years", ",").alias("yearly_counts"))
    )


def priority_set(orders: DataFrame) -> DataFrame:
    """Distinct order priorities of each customer (five possible values)."""
    return orders.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities")
    )


def urgent_order_counts(customer: DataFrame, orders: DataFrame) -> DataFrame:
    urgent = (
        orders.filter(F.col("o_orderpriority") == "1-URGENT").groupBy("o_custkey").agg(F.count("*").alias("n"))
    )
    return customer.join(urgent, customer["c_custkey"] == urgent["o_custkey"], "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("urgent_orders")
    )
