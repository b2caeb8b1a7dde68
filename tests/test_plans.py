"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from weftline.operators import retrieval as R
from weftline.operators.skew import salted_join
from weftline.sources import jsonl

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, key):
    return plan_of(entry_points.queries()[key](spark, FOLDER))


@pytest.fixture
def conf(spark):
    changed = {}

    def set_conf(**values):
        for name, value in values.items():
            key = name.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_conf
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("key", ["q04_top3_per_category", "q06_latest_record", "q19_second_highest", "r05_topk"])
def test_ranks_are_pruned_before_the_shuffle(spark, key):
    text = plan(spark, key)
    assert re.search(r"WindowGroupLimit .* Final[\s\S]*Exchange[\s\S]*WindowGroupLimit .* Partial", text)


@pytest.mark.parametrize("key,column", [
    ("q05_month_pivot", "l_shipdate"), ("q16_filter_sort", "o_orderdate"), ("q18_segment_average", "o_orderdate"),
    ("v01_where", "o_totalprice"),
])
def test_filters_reach_the_scan(spark, conf, key, column):
    conf(spark__sql__maxMetadataStringLength="5000")
    pushed = plan(spark, key)
    assert re.search(rf"PushedFilters: \[[^\]]*Greater\w+\({column}", pushed)


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "q01_category_sales")
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_no_query_joins_everything_with_everything(spark):
    for key in entry_points.queries():
        if key[0] in "qvedrx":
            text = plan(spark, key)
            assert "CartesianProduct" not in text and "NestedLoop" not in text, key


def test_numbered_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    text = plan_of(jsonl.read_lines(spark, str(tmp_path)))
    wide_side = text[: text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in wide_side and "value" in wide_side


def test_texts_of_the_index_meet_hits_alone(spark, conf):
    """The search reads ids and vectors; the texts are read once, for the join with the hits, and in no window or sort of the search."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    index = spark.range(10).select(F.col("id").alias("example_id"), F.lit("d").alias("description"),
                                   F.lit("c").alias("code"), F.array(F.lit(1.0)).alias("embedding"))
    queries = index.select(F.col("example_id").alias("query_id"), "embedding")
    text = plan_of(R.search_examples(index, queries))
    assert text.count("AS description") == 1 and "Window" not in text and "NestedLoop" not in text
    hits = plan_of(R.search(index, queries))
    assert "description" not in hits and "BroadcastExchange" not in hits


def test_hot_group_is_spread_by_salt(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    rows = spark.range(4000).select("id", F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("g"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"))
    joined = salted_join(rows, groups, ["g"], spread_by=["id"])
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert joined.filter("g = 0").select("n").distinct().first().n == 3000


def test_adaptive_execution_splits_a_hot_join_key(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10000",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20000",
    )
    from weftline.plans import reports
    from weftline.plans.registry import Tables

    t = Tables(spark, FOLDER)
    hot = F.when(F.col("l_linenumber") % 3 == 0, 11).otherwise(F.col("l_orderkey"))
    lines = t.lineitem.union(t.lineitem).union(t.lineitem).withColumn("l_orderkey", hot).repartition(4)
    summary = reports.order_summary(lines, t.orders, t.customer, t.part)
    rows = summary.count()
    assert rows == lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).count()
    executed = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    executed.collect()
    assert "skew=true" in plan_of(executed)


def test_hits_of_all_pairs_are_not_shuffled(spark):
    """What moves is rows and queries; the rows of the result, as many as there are pairs, leave the task that makes them in order."""
    hits, _, moved = plan(spark, "r06_k_beyond_index").partition("MapInArrow")
    assert "Exchange" in moved and not re.search("Exchange|Sort|Window", hits)
