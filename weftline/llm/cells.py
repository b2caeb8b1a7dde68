"""Queries against all rows in blocks: a block of vectors is held by one task while queries stream past it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions, stored

# Vectors that one task holds at a time, and queries that it works on together.
BLOCK_ROWS, TOGETHER = 1 << 14, 256
EXACT = 2.0**53


def whole_numbers(vector: str, scale: int) -> Column:
    """Components as whole numbers: floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: str) -> Column:
    """The vector is there, and each component is a finite number."""
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def numbered(vectors: DataFrame, name: str) -> DataFrame:
    """The rows with a number ``row`` each, stored: rows that repeat an id stay apart, and a row keeps its number."""
    return stored(vectors.withColumn("row", F.monotonically_increasing_id()), name)


def in_cells(rows: DataFrame, queries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows and queries (of the same columns, with ``row`` and ``turn``) by cells: ``kind`` 0 the block's rows, then ``kind`` 1 all queries of a share.

    A row is in one block, by a hash of its number. Every block meets every query. While there are fewer blocks than tasks, queries are
    dealt to shares, by ``turn``, and a block is made for each. Neither blocks nor shares depend on what the rows hold.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-rows.count() // block_rows))
    shares = max(1, -(-partitions(spark) // blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("share", each(shares)).withColumn("kind", F.lit(0))
    asked = queries.withColumn("share", F.pmod(F.xxhash64("turn"), F.lit(shares))).withColumn("block", each(blocks)).withColumn("kind", F.lit(1))
    asked = asked.select(*held.columns[:-2], F.col("share").cast("int").alias("share"), "kind")
    both = held.unionByName(asked).withColumn("cell", (F.col("block") * shares + F.col("share")).cast("int")).drop("block", "share")
    return both.repartition(blocks * shares, "cell").sortWithinPartitions("cell", "kind", "turn")


@dataclass
class Rows:
    """Some rows as arrays: row numbers, ids (``unnamed`` where null), vectors as a matrix of whole numbers, and the columns themselves."""

    row: np.ndarray
    id: np.ndarray
    unnamed: np.ndarray
    vectors: np.ndarray
    table: pa.Table

    def __len__(self) -> int:
        return len(self.row)


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of whole numbers as a matrix of doubles or, where those are too short, of 64-bit numbers; missing ends count as 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        out = flat.reshape(len(lengths), width)
    else:
        out = np.zeros((len(lengths), width), np.int64)
        begins = np.cumsum(lengths) - lengths
        out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(begins, lengths)] = flat
    return out if np.abs(out).max(initial=0) ** 2.0 * max(width, 1) >= EXACT else out.astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, as exact whole numbers (in doubles where these hold them)."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < EXACT:
        return a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T
    if most >= 2.0**56:
        raise ArithmeticError("components are too large for scores of 56 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _rows(batches: list[pa.RecordBatch]) -> Rows:
    table = pa.Table.from_batches(batches)
    ids = table["id"].combine_chunks()
    return Rows(
        table["row"].to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), matrix(table["vector"]), table)


def over_cells(index: Callable[[Rows], object], answer: Callable[[object, Rows], pa.RecordBatch | None], turns: bool = False):
    """For ``mapInArrow`` over ``in_cells``: ``index`` is made of each block, and ``answer`` given for queries, some at a time (of one ``turn`` where ``turns``).

    A task holds one block and at most ``TOGETHER`` queries, however many queries there are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, made, waiting = None, [], None, []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if waiting and held:
                if made is None:
                    made = index(_rows(held))
                found = answer(made, _rows(waiting))
                if found is not None and found.num_rows:
                    yield found
            waiting.clear()

        turn, count = None, 0
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "turn")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in (keys if turns else keys[:2])], axis=0)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b == e:
                    continue
                if keys[0][b] != cell:
                    yield from answers()
                    cell, held, made, turn, count = keys[0][b], [], None, None, 0
                if keys[1][b] == 0:
                    held.append(batch.slice(b, e - b))
                    continue
                if turns and keys[2][b] != turn:
                    yield from answers()
                    turn, count = keys[2][b], 0
                while b < e:
                    take = min(e - b, TOGETHER - count)
                    waiting.append(batch.slice(b, take))
                    b, count = b + take, count + take
                    if count == TOGETHER:
                        yield from answers()
                        count = 0
        yield from answers()

    return run


def best(group: np.ndarray, score: np.ndarray, rows: Rows, at: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group: by score, then id (null ids last), then row number."""
    order = np.lexsort((rows.row[at], rows.id[at], rows.unnamed[at], -score, group))
    ranked = group[order]
    rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    return order[rank < k]
