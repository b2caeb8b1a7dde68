"""Exact top-k search by inner product on an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.cells import BLOCK_ROWS, Rows, best, in_cells, numbered, over_cells, products, usable, whole_numbers

# Levels that impacts are quantised to, and the share of a block's rows (or multiple of k) that is few enough to be rescored.
LEVELS, FEW_SHARE, FEW = 6, 1 / 16, 8
FOUND = "query_row long, query_id long, score long, found_id long, found_row long"
_FOUND = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])


class ImpactIndex:
    """Postings of a block: for each dimension, the rows by value, so that the rows of a range of values are one segment.

    For a query, a posting counts how much more it gives than the dimension's worst value: its impact, which is never negative.
    """

    def __init__(self, rows: Rows) -> None:
        self.rows = rows
        self.values = np.ascontiguousarray(np.sort(rows.vectors, axis=0).T, np.float64)
        self.postings = np.ascontiguousarray(np.argsort(rows.vectors, axis=0, kind="stable").T)
        self.low, self.high = (self.values[:, at].copy() if len(rows) else np.zeros(len(self.values)) for at in (0, -1))
        # How far values lie above the lowest, and below the highest, of their dimension.
        self.above, self.below = self.values - self.low[:, None], self.high[:, None] - self.values
        # Memory for one level of one query, used again and again.
        self.at, self.gives = np.empty(self.postings.size, np.int64), np.empty(self.postings.size)
        self.shown = self.values[:, :: max(1, len(rows) // 64)].copy()
        self.places = {int(r): i for i, r in enumerate(rows.row.tolist())}

    def _levels(self, weights: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
        """Falling impacts, of which each bounds a level from below, and the segments (dimension, begin, end) of each level. The levels hold about as many postings each."""
        n, dims = len(self.rows), np.flatnonzero(weights)
        shown = np.sort((weights[dims, None] * (self.shown[dims] - worst[dims, None])).ravel())
        bounds = shown[(np.arange(LEVELS - 1, 0, -1) * len(shown)) // LEVELS]
        segments: list[list[tuple[int, int, int]]] = [[] for _ in range(LEVELS)]
        for d in dims.tolist():
            at = worst[d] + bounds / weights[d]
            if weights[d] > 0:
                cuts = [n, *self.values[d].searchsorted(at, "left").tolist(), 0]
            else:
                cuts = [0, *self.values[d].searchsorted(at, "right").tolist(), n]
            for level in range(LEVELS):
                a, b = cuts[level], cuts[level + 1]
                if a != b:
                    segments[level].append((d, a, b) if a < b else (d, b, a))
        return np.append(bounds, 0.0), segments

    def possible(self, query: np.ndarray, own: int | None, k: int) -> np.ndarray:
        """Positions of all rows that can be among the k best: found by segments of falling impact, up to the proof that all others cannot."""
        n = len(self.rows)
        few = max(FEW * k, int(FEW_SHARE * n))
        weights = np.zeros(len(self.values))
        width = min(len(query), len(weights))
        weights[:width] = query[:width]
        if n - (own is not None) <= few or not weights.any():
            return np.delete(np.arange(n), own) if own is not None else np.arange(n)
        worst = np.where(weights >= 0, self.low, self.high)
        most = np.abs(weights) * (self.high - self.low)
        slack = 1e-6 * max(float((np.abs(weights) * np.maximum(np.abs(self.low), np.abs(self.high))).sum()), 1.0)
        # One number for each row: what it has gained, and ``mark`` for each of its postings seen. All that can be gained lies below half a mark.
        mark = 2.0 ** np.ceil(np.log2(most.sum() + 1.0) + 1.0)
        state, bar = np.zeros(n), -np.inf
        bounds, levels = self._levels(weights, worst)
        for room, segments in zip(bounds, levels):
            if segments:
                size = 0
                for d, b, e in segments:
                    w, to = weights[d], size + e - b
                    self.at[size:to] = self.postings[d, b:e]
                    np.multiply((self.above if w > 0 else self.below)[d, b:e], abs(w), out=self.gives[size:to])
                    size = to
                self.gives[:size] += mark
                state += np.bincount(self.at[:size], self.gives[:size], n)
            # What is not yet seen of a row lies below this level in each dimension; a dimension seen had at least as much room.
            reach = state - (mark + room) * np.floor(state / mark)
            if own is not None:
                reach[own] = -np.inf
            # The k-th best score of the most promising rows, taken exactly, is one that the k best reach.
            promising = np.argpartition(reach, n - 2 * k)[n - 2 * k :]
            promising = promising[promising != own] if own is not None else promising
            exact = (self.rows.vectors[promising] - worst) @ weights
            bar = max(bar, np.partition(exact, len(exact) - k)[len(exact) - k])
            members = np.flatnonzero(reach >= bar - np.minimum(most, room).sum() - slack)
            if len(members) <= few:
                break
        return members[members != own] if own is not None else members


def _answer(k: int):
    def run(index: ImpactIndex, queries: Rows) -> pa.RecordBatch | None:
        group, at = [], []
        for i, (row, vector) in enumerate(zip(queries.row.tolist(), queries.vectors)):
            members = index.possible(vector, index.places.get(row), k)
            group.append(np.full(len(members), i))
            at.append(members)
        group, at = np.concatenate(group), np.concatenate(at)
        if not len(at):
            return None
        scores = np.empty(len(at), np.int64)
        cuts = np.searchsorted(group, np.arange(len(queries) + 1))
        for i in range(len(queries)):
            of = slice(cuts[i], cuts[i + 1])
            scores[of] = products(queries.vectors[i : i + 1], index.rows.vectors[at[of]])[0].astype(np.int64)
        kept = best(group, scores, index.rows, at, k)
        group, at = group[kept], at[kept]
        ids = pa.array(index.rows.id[at], mask=index.rows.unnamed[at])
        named = pa.array(queries.id[group], mask=queries.unnamed[group])
        return pa.RecordBatch.from_arrays([pa.array(queries.row[group]), named, pa.array(scores[kept]), ids, pa.array(index.rows.row[at])], schema=_FOUND)

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = 2 * BLOCK_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the highest inner products with each row where ``is_query``: query_id, rank, vec_id, score.

    Components count as whole numbers floor(scale * x); scores are exact. Ties go to the smaller vec_id. A query's own row is no
    candidate of it; other rows of the same id are.

    The rows are dealt to blocks of about ``block_rows``. A task indexes a block: for each dimension and value the rows that have it. Queries stream past. For each, the
    segments are processed by falling quantised impact, rows gather what the segments give, and after each level it is known what a row can still get. Once
    no more than a sixteenth of the block can be among the k best, those rows are rescored exactly, all of them; without such proof all levels are processed.
    The best of the blocks are ranked at the end, k of each block for each query at most. No block and no query is left out.

    Null vectors and vectors with null or non-finite components take no part. Vectors of different lengths are compared as if the shorter one ended in zeros; an empty one scores 0. Null
    ids rank behind others of the same score. Rows that repeat stay apart: repeated queries are answered each. Fewer candidates than k
    give fewer rows, no rows give none. Other columns are not read. Components too large for scores of 56 bits stop the job.
    """
    rows = vectors.filter(usable("embedding")).select(
        F.col("vec_id").cast("long").alias("id"), whole_numbers("embedding", scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = numbered(rows, "whole-vectors").withColumn("turn", F.col("row"))
    cells = in_cells(rows.drop("asks"), rows.filter("asks").drop("asks"), block_rows)
    found = cells.mapInArrow(over_cells(ImpactIndex, _answer(k)), FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found_id").alias("vec_id"), "score")
