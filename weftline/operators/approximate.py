"""Approximate cosine top-k search over buckets of random planes, with exact scores.

``retrieval.search`` is exact and stays the default. Here the sides that a vector takes of random planes name its bucket, and each query looks into the
buckets where a neighbour is likely to lie, as many as the wanted recall asks for. Vectors have unit length, as ``build_index`` makes them.

How many buckets that is depends on the vectors: few where a query has near neighbours, and nearly the wanted share of all of them where there are none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.retrieval import (
    CALLS, CELL_ROWS, DEFAULT_K, _common_length, _matrix, _numbers, _unit, block_hits, calls_of, gather_cells, looked_up, merge_hits, search, tasks_of, vector_problem, visits_of,
)
from weftline.session import stored

# Planes at most (a bucket with more rows than a cell is dealt to several cells), the seed of their directions, and queries that a step looks at together.
PLANES, SEED, STEP = 12, 20_011, 64
RECALL = 0.95
# Rows for each hit wanted that the first buckets of a query hold: more of them give a better estimate of how near the hits are.
HOME_ROWS = 8


@dataclass(frozen=True)
class Buckets:
    """Unit normals of the planes, and for each of the 2^planes buckets its rows and the cells that they are dealt to."""

    normals: np.ndarray
    rows: np.ndarray
    parts: np.ndarray

    @property
    def length(self) -> int:
        return self.normals.shape[1]

    @property
    def cells(self) -> int:
        return int(self.parts.sum())

    @property
    def first(self) -> np.ndarray:
        """Number of the first cell of each bucket."""
        return np.cumsum(self.parts) - self.parts

    @property
    def sizes(self) -> np.ndarray:
        """About how many rows each cell has."""
        return np.repeat(-(-self.rows // np.maximum(self.parts, 1)), self.parts)


@dataclass(frozen=True)
class BucketIndex:
    """Stored (example_id, embedding, bucket, cell) rows and the shape of the buckets."""

    rows: DataFrame
    shape: Buckets


def _codes(margins: np.ndarray) -> np.ndarray:
    """The number of the bucket: a bit for each plane, set on its upper side."""
    return ((margins > 0) << np.arange(margins.shape[1])).sum(axis=1)


def bucket_index(index: DataFrame, cell_rows: int = CELL_ROWS, seed: int = SEED) -> BucketIndex | None:
    """Deal the usable vectors of ``index`` (example_id, embedding) to buckets of about ``cell_rows``. None when no row is usable.

    The rows of a bucket with more, such as one of many copies, are dealt to several cells by a hash of their id. Rows that are left out are those that
    ``rejected_examples`` names. At most 2^``PLANES`` counts come to the driver.
    """
    numbers = _numbers((index, "embedding"))
    index = index.select(F.col("example_id").cast("bigint").alias("example_id"), F.col("embedding").cast(numbers).alias("embedding"))
    common = _common_length(index)
    if common is None:
        return None
    length, rows = common
    planes = min(PLANES, max(1, math.ceil(math.log2(rows / cell_rows)))) if rows > cell_rows else 1
    normals = _unit(np.random.default_rng(seed).normal(size=(planes, length)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            codes = _codes(vectors @ normals.T) if len(vectors) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.astype(np.int32))], ["example_id", "embedding", "bucket"])

    usable = index.filter(vector_problem("embedding", length).isNull())
    placed = stored(usable.mapInArrow(assign, f"example_id bigint, embedding {numbers}, bucket int"), "index-buckets")
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n")).toPandas()
    held = np.zeros(1 << planes, np.int64)
    held[counts["bucket"]] = counts["n"]
    shape = Buckets(normals, held, -(-held // cell_rows))
    part = F.pmod(F.xxhash64("example_id"), looked_up(np.maximum(shape.parts, 1), "bucket"))
    return BucketIndex(placed.withColumn("cell", (looked_up(shape.first, "bucket") + part).cast("int")), shape)


def _flip_chance(margins: np.ndarray, cosine: np.ndarray, length: int) -> np.ndarray:
    """How likely a vector at that cosine to a query lies on the other side of each plane.

    Its distance from the plane is the cosine times the query's, plus a part across the query, which is about normal.
    """
    cosine = np.clip(cosine, 0.0, 1.0 - 1e-9)[:, None]
    across = np.sqrt((1.0 - cosine**2) * np.maximum(1.0 - margins**2, 1e-12) / max(1, length - 1))
    return np.vectorize(math.erfc, otypes=[float])(cosine * np.abs(margins) / (across * math.sqrt(2.0))) / 2.0


def _likely(shape: Buckets, vectors: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets by falling chance, their chances) for each query, over the buckets that hold rows."""
    units = _unit(vectors)
    margins = units @ shape.normals.T
    flip = np.clip(_flip_chance(margins, cosine, shape.length), 1e-12, 0.5)
    masks = np.arange(len(shape.rows))
    bits = ((masks[:, None] >> np.arange(margins.shape[1])) & 1).astype(float)
    logs = np.log1p(-flip).sum(axis=1)[:, None] + (np.log(flip) - np.log1p(-flip)) @ bits.T
    buckets = _codes(margins)[:, None] ^ masks
    chances = np.where(shape.rows[buckets] > 0, np.exp(logs - logs.max(axis=1, keepdims=True)), -1.0)
    order = np.lexsort((buckets, -chances), axis=1)
    return np.take_along_axis(buckets, order, 1), np.maximum(np.take_along_axis(chances, order, 1), 0.0)


def _chosen(shape: Buckets, vectors: np.ndarray, bar: np.ndarray | None, k: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(query position, bucket): the likeliest buckets that together hold ``HOME_ROWS`` times k rows, or those besides them that the recall asks for."""
    # Home is chosen at one cosine for all queries, so that both rounds choose alike.
    near, _ = _likely(shape, vectors, np.full(len(vectors), 0.5))
    held = shape.rows[near]
    home = (np.cumsum(held, axis=1) - held < HOME_ROWS * k) & (held > 0)
    if bar is None:
        at, place = np.nonzero(home)
        return at, near[at, place]
    norms = np.linalg.norm(vectors, axis=1)
    buckets, chances = _likely(shape, vectors, np.divide(bar, norms, out=np.zeros_like(bar), where=norms > 0))
    before = np.cumsum(chances, axis=1) - chances
    wanted = shape.rows[buckets] > 0
    if recall < 1.0:
        wanted &= before < recall * chances.sum(axis=1, keepdims=True)
    seen = np.zeros_like(home)
    np.put_along_axis(seen, near, home, 1)
    at, place = np.nonzero(wanted & ~np.take_along_axis(seen, buckets, 1))
    return at, buckets[at, place]


def _probed(shape: Buckets, k: int, recall: float | None):
    """For queries and their bars, whether they look into each cell, at home if ``recall`` is None."""

    def choose(vectors: np.ndarray, bar: np.ndarray) -> np.ndarray:
        at, buckets = _chosen(shape, vectors, None if recall is None else bar, k, recall)
        wanted = np.zeros((len(vectors), len(shape.parts)), bool)
        wanted[at, buckets] = True
        return np.repeat(wanted, shape.parts, axis=1)

    return choose


@dataclass(frozen=True)
class Probed:
    """``hits`` (query_id, rank, example_id, score), the usable queries, and all (query_id, cell) that were looked into."""

    hits: DataFrame
    queries: DataFrame
    visits: DataFrame
    cells: int

    def visited_share(self) -> float:
        """Visits over those of a search of all cells."""
        return self.visits.count() / max(1, self.queries.count() * self.cells)


def search_buckets(index: BucketIndex, queries: DataFrame, k: int | None = None, recall: float = RECALL) -> Probed:
    """Hits of all usable queries (query_id, embedding), with exact scores.

    Every query first looks into its likeliest buckets that hold ``HOME_ROWS`` times k rows. The k-th best score there is a cosine that the true hits reach, and tells how likely one of them lies in each
    other bucket; the query looks into the likeliest ones until their chances add up to ``recall``. With 1.0 it looks into all, and the hits are those of the exact search.
    """
    if not 0.0 < recall <= 1.0:
        raise ValueError(f"recall is not in (0, 1]: {recall}")
    k = k or DEFAULT_K
    numbers = _numbers((index.rows, "embedding"), (queries, "embedding"))
    called, visited = CALLS.format(numbers), "query_id bigint, cell int"
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast(numbers).alias("vector")).filter(vector_problem("vector", index.shape.length).isNull())
    asked = asked.withColumn("bar", F.lit(float("-inf")))
    rows = index.rows.select("cell", "example_id", "embedding")
    blocks = gather_cells(index.shape.sizes, index.shape.length, tasks_of(queries))
    at_home, elsewhere = _probed(index.shape, k, None), _probed(index.shape, k, recall)
    near = stored(block_hits(rows, blocks, asked.mapInArrow(calls_of(at_home, blocks, STEP), called), k), "near-hits")
    # Of the hits so far, the least of the k best: no lower than the k-th best of all cells can be taken for.
    bars = merge_hits(near, k).groupBy("query_id").agg(F.min("score").alias("bar"))
    others = asked.drop("bar").join(bars, "query_id").select("query_id", "vector", "bar")
    hits = merge_hits(near.unionByName(block_hits(rows, blocks, others.mapInArrow(calls_of(elsewhere, blocks, STEP), called), k)), k)
    visits = asked.mapInArrow(visits_of(at_home, STEP), visited).unionByName(others.mapInArrow(visits_of(elsewhere, STEP), visited))
    return Probed(hits, asked, visits, index.shape.cells)


def search_approximately(index: DataFrame | BucketIndex, queries: DataFrame, k: int | None = None, recall: float = RECALL, cell_rows: int = CELL_ROWS) -> DataFrame:
    """About the ``k`` best index rows of every query: (query_id, rank, example_id, score), of which a share of at least ``recall`` is expected to be right."""
    buckets = index if isinstance(index, BucketIndex) else bucket_index(index, cell_rows)
    if buckets is None:
        return search(index, queries, k)
    return search_buckets(buckets, queries, k, recall).hits


def recall_of(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """(wanted, found): how many exact hits there are, and how many of them are among ``hits``."""
    found = hits.select("query_id", "example_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "example_id"], "left").agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
