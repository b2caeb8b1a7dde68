import os
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import dataset as D
from weftline.sources import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_part_names_are_external_tables(spark, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "it's second")
    spark.range(3).write.parquet(first)
    spark.range(5).withColumn("x", F.lit("y")).write.parquet(second)
    catalog.create_table(spark, "shop.orders", first)
    assert catalog.scan(spark, "shop.orders").count() == 3
    # A table that is made anew gets other columns and another place; no file goes.
    catalog.create_table(spark, "shop.orders", second)
    assert catalog.scan(spark, "shop.orders").columns == ["id", "x"] and catalog.scan(spark, "shop.orders").count() == 5
    assert spark.read.parquet(first).count() == 3 and os.path.isdir(first)
    for name in ("a.b.c", "a.", "", "."):
        with pytest.raises(ValueError):
            catalog.scan(spark, name)


def test_partitions_are_discovered_and_pruned(spark, tmp_path):
    place = str(tmp_path / "by-year")
    spark.range(100).withColumn("year", 2000 + F.col("id") % 5).write.partitionBy("year").parquet(place)
    catalog.create_table(spark, "shop.by_year", place)
    one = catalog.scan(spark, "shop.by_year").filter("year = 2003")
    assert one.count() == 20 and re.search(r"PartitionFilters: \[[^\]]*year#\d+L? = 2003", plan_of(one))


def test_unknown_tables_against_the_listing(spark, tmp_path):
    place = str(tmp_path / "known")
    spark.range(1).write.parquet(place)
    catalog.create_tables(spark, {"desk.known": place, "desk.also": place})
    spark.range(1).createOrReplaceTempView("passing")
    code = spark.createDataFrame([('spark.table("desk.known").join(spark.table("desk.gone"), "id")',), ("spark.table('desk.gone')",), (None,)], "code string")
    listing = catalog.catalog_listing(spark, ["desk"])
    assert sorted(r.table_name for r in listing.collect()) == ["desk.also", "desk.known"]
    assert [tuple(r) for r in D.unknown_tables(code, listing).collect()] == [("desk.gone", 2)]
    everywhere = {r.table_name for r in catalog.catalog_listing(spark).collect()}
    assert {"desk.known", "desk.also"} <= everywhere and "passing" not in everywhere
