"""Joins on keys that hold very unequal numbers of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    rows: DataFrame, groups: DataFrame, key: Sequence[str], spread_by: Sequence[str], salts: int | None = None
) -> DataFrame:
    """Inner join of ``rows`` with per-group values, where few groups may own most rows.

    ``groups`` has one row per key, such as an aggregate, and is copied once per salt. A group's
    rows go to as many tasks as there are salts (by default, the session's shuffle partitions), chosen by a hash of ``spread_by`` (so a task
    that is run again finds the same rows). Nothing is broadcast by hint; the optimizer still
    does so by itself where it finds the groups to be small.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*key, "_salt"]).drop("_salt")


def salted_by_count(rows: DataFrame, wide: DataFrame, key: str, spread_by: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` (which are read three times, to count them first) with ``wide`` rows of unique ``key``, where few keys may own most of ``rows``.

    With P shuffle partitions, a key with more than 1/P of the rows is hot. There are fewer than P hot keys, so their list is broadcast. The rows of a hot key are
    dealt, by a hash of ``spread_by``, over as many tasks as its share asks for, and its wide row is copied to these; all other rows are neither salted nor copied.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = max(1, rows.count())
    hot = counts.filter(F.col("_n") * parts > total).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") * parts / total).cast("int").alias("_deal"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_deal").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread_by), F.col("_deal")).cast("int"))).drop("_hot", "_deal")
    copies = wide.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_deal", F.lit(1)) - 1))).drop("_hot", "_deal")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
