"""Dense numbering and positional splits without a global one-task window.

Positions are 64-bit whole numbers, unique per group.

Numbering is a distributed prefix sum: narrow (group, position) rows are dealt to tasks by ranges, each task counts
and numbers its own, and the counts of the tasks before are added.

For the split, counts are taken over buckets of ``WIDTH`` positions, over ``WIDTH`` of those buckets, and so on. So no window
ever holds more than ``WIDTH`` rows of one parent bucket, however the positions are spread. Three levels
cover every 64-bit number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import stored

WIDTH = 1_000_000
ALL_LEVELS = 3


def _bucket(column: str, width: int) -> Column:
    return F.expr(f"`{column}` div {width}")


def _count_levels(df: DataFrame, position: str, within: Sequence[str], levels: int, width: int) -> list[DataFrame]:
    """Row counts (*within, _b, _rows) per bucket, finest level first."""
    counts = []
    current = df.select(*within, F.col(position).alias("_b"), F.lit(1).alias("_rows"))
    for _ in range(levels):
        current = current.groupBy(*within, _bucket("_b", width).alias("_b")).agg(F.sum("_rows").alias("_rows"))
        counts.append(current)
    return counts


def _rows_before(*, parent: Sequence[str], order: Sequence[str]) -> Column:
    window = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_rows").over(window), F.lit(0))


def dense_ordinal(df: DataFrame, position: str, out: str = "ordinal", within: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based rank of each row in (``within``, ``position``) order (nulls first).

    Only (``within``, ``position``) is dealt out by ranges and sorted. Each task numbers its range and the numbers are
    stored; one count for each task comes to the driver, which adds them up. The wide rows are in no window and not sorted by range: they meet
    their number in an equi-join on (``within``, ``position``). ``df`` is read twice. Rows that repeat a position of their group
    have no order, and are an error of the caller.
    """
    spark, key = df.sparkSession, [*within, position]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_key_{i}" for i in range(len(key))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(key, names)])
    ranged = narrow.repartitionByRange(tasks, *names).sortWithinPartitions(*names)
    # The number within a task is the row number that Spark gives, less the part of it that names the task.
    numbered = stored(ranged.withColumn("_task", F.spark_partition_id()).withColumn(
        "_rank", F.monotonically_increasing_id() - F.shiftleft(F.col("_task").cast("bigint"), 33)), "ordinals")
    counts = {row["_task"]: row["n"] for row in numbered.groupBy("_task").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for task in range(tasks):
        offsets.append(before)
        before += counts.get(task, 0)
    ordinal = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in offsets]), F.col("_task") + 1) + F.col("_rank")
    ranks = numbered.select(*names, ordinal.alias(out))
    same = reduce(and_, [df[c].eqNullSafe(ranks[n]) for c, n in zip(key, names)])
    return df.join(ranks, same).select(*[df[c] for c in df.columns], ranks[out])


def train_rows(total: Column, val_split: float) -> Column:
    """``max(1, int(n * (1 - val_split)))``, truncated exactly as in double arithmetic."""
    return F.greatest(F.lit(1).cast("bigint"), (total.cast("double") * F.lit(1 - val_split)).cast("bigint"))


def positional_split(
    df: DataFrame,
    position: str,
    val_split: float = 0.1,
    within: Sequence[str] = (),
    out: str = "split",
    levels: int = ALL_LEVELS,
    width: int = WIDTH,
) -> DataFrame:
    """Mark the first ``train_rows`` rows as 'train' and the rest as 'val'.

    Only the position of the last training row is needed. The bucket counts lead down to the
    bucket it is in, and just that bucket is ranked; the rows themselves are never shuffled.
    """
    narrow = df.select(*within, position)
    *finer, top = _count_levels(narrow, position, within, levels, width)

    def holding_nth(counts: DataFrame, before: Column) -> DataFrame:
        """The one bucket that row number ``_nth`` falls into, and its number in there."""
        return (
            counts.withColumn("_before", before)
            .filter((F.col("_before") < F.col("_nth")) & (F.col("_nth") <= F.col("_before") + F.col("_rows")))
            .select(*within, "_b", (F.col("_nth") - F.col("_before")).alias("_nth"))
        )

    total = F.sum("_rows").over(Window.partitionBy(F.lit(0)))
    cut = holding_nth(
        top.withColumn("_nth", train_rows(total, val_split)), _rows_before(parent=[], order=[*within, "_b"])
    )
    # ``cut`` is one row at every level, hence the broadcasts.
    for counts in reversed(finer):
        inside = counts.withColumn("_p", _bucket("_b", width)).join(
            F.broadcast(cut.withColumnRenamed("_b", "_p")), [*within, "_p"]
        )
        cut = holding_nth(inside, _rows_before(parent=[*within, "_p"], order=["_b"]))
    rank = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(position))
    last_train = (
        narrow.withColumn("_b", _bucket(position, width))
        .join(F.broadcast(cut), [*within, "_b"])
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_nth"))
        .select(F.struct(*within, position).alias("last"))
    )
    here = F.struct(*[F.col(c) for c in (*within, position)])
    return df.withColumn(out, F.when(here <= last_train.scalar(), "train").otherwise("val"))
