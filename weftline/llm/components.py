"""Connected components of a graph of any size, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import join_hot, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _least(near: DataFrame) -> DataFrame:
    """The least neighbour and the number of neighbours of each node."""
    return stored(near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")


def _star(near: DataFrame, least: DataFrame, weights: tuple[int, int] | None, large: bool) -> DataFrame:
    """Link neighbours to the least node around: of each node's larger neighbours, or of its smaller ones and itself."""
    met = join_hot(near, least.withColumn("m", F.least("m", "a")), ["a"], "n", ["b"], weights)
    out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(
        F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    out = out.filter("a <> b")
    # Large stars have no more rows than links went in, repeats or not, and what follows counts and groups them anyway.
    return stored(out if large else out.distinct(), "stars")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Large-star and small-star rounds, each a grouping and a join, until no node with a lesser neighbour has another one, too, so that
    all are linked to their roots alone; a graph of n nodes needs about log n of them. No neighbourhood is gathered in one task.
    No edges give no rows; loops and repeats are harmless.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(rounds):
        near = _both_ways(now)
        least = _least(near)
        total, most, between = least.agg(F.sum("n"), F.max("n"), F.count_if((F.col("m") < F.col("a")) & (F.col("n") > 1))).first()
        if not between:
            break
        now = _star(near, least, (total, most), True)
        now = _star(now, _least(now), None, False)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) after ``pairs`` (a, b) are added to the links whose components are ``roots`` (stored).

    A pair counts as a link between the roots of its ends, so that the rounds work on what is not yet joined, however large the components are.
    """
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    named = pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = stored(components(named), "moved-roots")
    kept = roots.join(moved.toDF("root", "now"), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return kept.unionByName(moved.join(roots, "node", "left_anti"))
