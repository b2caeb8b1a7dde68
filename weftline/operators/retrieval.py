"""Exact cosine top-k search over an embedding column.

Scores are inner products of unit vectors, taken in double precision. Hits are ranked by the
score rounded to ``RANK_DIGITS`` and then by ascending id, so equal vectors always rank the
same whatever batch they were scored in.

The index is partitioned into cells: vectors around a centroid, within a known angle of it. A query's angle to a centroid bounds
its score with every vector of the cell, since angles obey the triangle inequality. Cells whose bound lies below the k-th best
score that a query has already are skipped. There is one way for any number of queries and index rows.

A task holds a block of cells. A query is sent once to each block that has cells it looks into, with a bit for each of them, however many and small the cells are.

Queries that ask for all rows skip no cell, and their hits are as many as the pairs. They meet the whole index in one task, which ranks a few of them at a time: rows are
copied to each task, and hits are neither shuffled nor stored.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from weftline.functions.text import _col
from weftline.operators.skew import salted_by_count
from weftline.session import stored

DEFAULT_K = 3
RANK_DIGITS = 10
# Rounding moves a score by half a unit at most, so scores this far below the bar cannot tie with it.
RANK_SLACK = 2 * 10.0**-RANK_DIGITS
# Index rows of a cell, and queries that a task scores together.
CELL_ROWS, QUERIES_PER_STEP = 16_384, 512
# Bytes of vectors (in double precision) of a block, which a task holds; rows that it scores at a time; hits of a step's queries that it holds.
BLOCK_BYTES, TILE_ROWS, STEP_HITS = 1 << 25, 2_048, 1 << 20
# Where queries ask for all rows: bytes of the scores (in double precision) that a task ranks together, and hits handed on at a time.
RANK_BYTES, SENT_HITS = 1 << 25, 1 << 16
# Centroids at most, the vectors that they are learnt from at most, and rounds of learning.
CENTROIDS, SAMPLE, ROUNDS = 256, 16_384, 6
# Cells whose hits are merged before the merge of all.
MERGED_CELLS = 16

HITS = "query_id bigint, cell int, example_id bigint, score double, rank_score double"
_HITS_ARROW = pa.schema([
    ("query_id", pa.int64()), ("cell", pa.int32()), ("example_id", pa.int64()), ("score", pa.float64()), ("rank_score", pa.float64()),
])


# -- column expressions -----------------------------------------------------------------------


def inner_product(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays zero."""
    v = _col(v)
    norm = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)).cast("float"))


# -- index ---------------------------------------------------------------------------------------


def vector_problem(v: Column | str, length: int | None = None) -> Column:
    """What keeps a vector from being searched, or null: it is missing, empty, not of ``length``, or has a null or non-finite element."""
    v = _col(v)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    other = F.lit(False) if length is None else F.size(v) != length
    return (
        F.when(v.isNull(), "no vector")
        .when(F.size(v) == 0, "empty vector")
        .when(other, F.format_string(f"vector length %d, expected {length}", F.size(v)))
        .when(~finite, "vector with a null or non-finite element")
    )


def _common_length(df: DataFrame, embedding: str = "embedding") -> tuple[int, int] | None:
    """(length, rows) of the usable vectors of the most frequent length."""
    usable = df.filter(vector_problem(embedding).isNull()).groupBy(F.size(embedding).alias("n")).agg(F.count("*").alias("rows"))
    row = usable.orderBy(F.desc("rows"), "n").first()
    return None if row is None else (row.n, row.rows)


def vector_length(df: DataFrame, embedding: str = "embedding") -> int | None:
    """The length that most usable vectors of the table have (of lengths as frequent, the least), or None when there is none."""
    common = _common_length(df, embedding)
    return None if common is None else common[0]


def same_length(v: Column | str, length: int | None) -> Column:
    """The vector itself; one that cannot be searched, or of any other length, stops the job."""
    v = _col(v)
    problem = vector_problem(v, length)
    return F.when(problem.isNull(), v).otherwise(F.raise_error(problem).cast("array<float>"))


def build_index(examples: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Index rows (example_id, description, code, embedding): unit vectors of one length."""
    vector = same_length(embedding, vector_length(examples, embedding))
    return examples.select("example_id", "description", "code", l2_normalize(vector).alias("embedding"))


def new_examples(examples: DataFrame, index: DataFrame) -> DataFrame:
    """Examples that the index does not hold yet: what a re-index has to embed."""
    return examples.join(index.select("example_id"), "example_id", "left_anti")


# -- search ---------------------------------------------------------------------------------------


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column (of lists of one length) to a float64 matrix."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if len(vectors) == 0:
        return np.empty((0, 0))
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _numbers(*columns: tuple[DataFrame, str]) -> str:
    """The type that vectors are moved in: single precision if all are given so, else double."""
    floats = all(df.schema[name].dataType == ArrayType(FloatType(), df.schema[name].dataType.containsNull) for df, name in columns)
    return "array<float>" if floats else "array<double>"


def _number(numbers: str) -> np.dtype:
    return np.dtype(np.float32 if numbers == "array<float>" else np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(vectors) @ centroids.T, -1.0, 1.0))


def learn_centroids(index: DataFrame, centroids: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors at the centres of clusters, by spherical k-means on ``sample`` vectors at most (those whose id has the least hash).

    They decide which cells can be skipped, not which hits are found.
    """
    units = _unit(_matrix(index.orderBy(F.xxhash64("example_id"), "example_id").limit(sample).select("embedding").toArrow()["embedding"]))
    found = units[:: max(1, len(units) // centroids)][:centroids]
    for _ in range(ROUNDS if len(found) > 1 else 0):
        nearest = (units @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, units)
        found = np.where((sums != 0).any(axis=1, keepdims=True), _unit(sums), found)
    return found


@dataclass(frozen=True)
class Geometry:
    """For each centroid its direction, the widest angle to it, the longest vector around it, its rows and the parts that they are dealt to; and the length of all vectors."""

    centroids: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    length: int

    @property
    def cells(self) -> int:
        return int(self.parts.sum())

    @property
    def first(self) -> np.ndarray:
        """Number of the first cell around each centroid."""
        return np.cumsum(self.parts) - self.parts

    @property
    def sizes(self) -> np.ndarray:
        """About how many rows each cell has."""
        return np.repeat(-(-self.rows.astype(np.int64) // np.maximum(self.parts, 1)), self.parts)


@dataclass(frozen=True)
class CellIndex:
    """An index dealt to cells: stored (example_id, embedding, norm, centroid, part) rows, where the part is a hash of the id, and the geometry of the cells."""

    rows: DataFrame
    shape: Geometry


def partition_index(index: DataFrame, cell_rows: int = CELL_ROWS) -> CellIndex | None:
    """Deal the usable vectors of ``index`` to cells of about ``cell_rows``, around as many centroids as that makes, ``CENTROIDS`` at most. None when no row is usable.

    A cell index can be searched any number of times. Rows that are left out are named by ``rejected_examples``.
    """
    numbers = _numbers((index, "embedding"))
    index = index.select(F.col("example_id").cast("bigint").alias("example_id"), F.col("embedding").cast(numbers).alias("embedding"))
    common = _common_length(index)
    if common is None:
        return None
    length, usable_rows = common
    usable = index.filter(vector_problem("embedding", length).isNull())
    wanted = min(CENTROIDS, -(-usable_rows // cell_rows))
    # A single cell needs no direction of its own.
    centroids = learn_centroids(usable, wanted) if wanted > 1 else np.eye(1, length)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            angles = _angles(vectors, centroids) if len(vectors) else np.empty((0, len(centroids)))
            nearest = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.linalg.norm(vectors, axis=1)), pa.array(nearest.astype(np.int32)), pa.array(angles[np.arange(len(nearest)), nearest])],
                ["example_id", "embedding", "norm", "centroid", "angle"])

    placed = stored(usable.mapInArrow(assign, f"example_id bigint, embedding {numbers}, norm double, centroid int, angle double"), "index-cells")
    # One row for each centroid.
    shape = placed.groupBy("centroid").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"), F.max("norm").alias("norm")).toPandas()
    rows, radius, norm = (np.zeros(len(centroids)) for _ in range(3))
    rows[shape["centroid"]], radius[shape["centroid"]], norm[shape["centroid"]] = shape["rows"], shape["radius"], shape["norm"]
    parts = np.ceil(rows / cell_rows).astype(np.int64)
    part = F.pmod(F.xxhash64("example_id"), looked_up(np.maximum(parts, 1), "centroid")).cast("int")
    return CellIndex(placed.drop("angle").withColumn("part", part), Geometry(centroids, radius, norm, rows, parts, length))


def _bounds(queries: np.ndarray, index: Geometry) -> np.ndarray:
    """The best score that each query can have in the cells of each centroid; rounding must not make it too small."""
    between = np.maximum(_angles(queries, index.centroids) - index.radius, 0.0)
    norms = np.linalg.norm(queries, axis=1)[:, None] * index.norm
    # A product of vectors of other lengths is greatest at the longest one where the cosine is positive, and at none above 0 elsewhere.
    return norms * np.maximum(np.cos(between), 0.0) + 1e-7 * (1.0 + norms)


def _wanted(index: Geometry, home: bool | None):
    """For queries and their bars, whether they look into each cell: the first part around the nearest centroid, or all others whose bound reaches the bar; any cell if ``home`` is None."""
    first = index.first

    def choose(vectors: np.ndarray, bar: np.ndarray) -> np.ndarray:
        if home is None:
            return np.ones((len(vectors), index.cells), bool)
        nearest = np.where(index.parts > 0, _angles(vectors, index.centroids), np.inf).argmin(axis=1)
        wanted = np.zeros((len(vectors), index.cells), bool) if home else np.repeat(_bounds(vectors, index) >= bar[:, None], index.parts, axis=1)
        wanted[np.arange(len(vectors)), first[nearest]] = home
        return wanted

    return choose


# -- cells by blocks -------------------------------------------------------------------------------


def looked_up(values: np.ndarray, at: str) -> Column:
    """The value at the number in column ``at``; one literal, however many values there are."""
    return F.element_at(F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<int>"), F.col(at) + 1)


@dataclass(frozen=True)
class Blocks:
    """For each cell its block; for each block its first cell, and at last the number of all cells; and how many tasks hold each block, each for a share of the queries."""

    of: np.ndarray
    begins: np.ndarray
    shares: int


def gather_cells(sizes: np.ndarray, length: int, tasks: int) -> Blocks:
    """Put consecutive cells (of so many rows) in blocks of about ``BLOCK_BYTES``; of fewer where the index is small.

    Rows are copied for each share and queries for each block: with about as many blocks as shares, both are moved least.
    """
    least = -(-int(sizes.sum()) // max(1, math.isqrt(tasks)))
    target = max(1, min(BLOCK_BYTES // (8 * length), least))
    _, of = np.unique((np.cumsum(sizes) - sizes) // target, return_inverse=True)
    begins = np.searchsorted(of, np.arange(of[-1] + 2))
    return Blocks(of, begins, max(1, -(-tasks // (len(begins) - 1))))


CALLS = "query_id bigint, vector {}, bar double, block int, cells binary"


def calls_of(choose, blocks: Blocks, step: int | None = None):
    """(query_id, vector, bar, block, cells): a row for each block in which ``choose(vectors, bar)`` has a query look into cells, with a bit for each cell of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, wanted in _chosen_by_step(choose, batches, step):
            for block, (b, e) in enumerate(zip(blocks.begins[:-1], blocks.begins[1:])):
                at = np.flatnonzero(wanted[:, b:e].any(axis=1))
                if len(at):
                    bits = np.packbits(wanted[at, b:e], axis=1)
                    cells = pa.Array.from_buffers(pa.binary(bits.shape[1]), len(at), [None, pa.py_buffer(bits)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*some.take(pa.array(at)).columns, pa.array(np.full(len(at), block, np.int32)), cells], ["query_id", "vector", "bar", "block", "cells"])

    return run


def visits_of(choose, step: int | None = None):
    """(query_id, cell): the cells that ``choose`` has each query look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, wanted in _chosen_by_step(choose, batches, step):
            at, cells = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(at)), pa.array(cells.astype(np.int32))], ["query_id", "cell"])

    return run


def _chosen_by_step(choose, batches: Iterator[pa.RecordBatch], step: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = step or QUERIES_PER_STEP
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            some = batch.slice(begin, step)
            yield some, choose(_matrix(some.column("vector")), some.column("bar").to_numpy(zero_copy_only=False))


def _ranked(where: np.ndarray, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """(query position, row position, score, rounded score) of the k best hits of each query; ties go to the lower id."""
    ranked = np.round(scores, RANK_DIGITS)
    order = np.lexsort((ids[at], -ranked, where))
    where = where[order]
    kept = np.arange(len(where)) - np.searchsorted(where, where) < k
    order = order[kept]
    return where[kept], at[order], scores[order], ranked[order]


def _best(vectors: np.ndarray, bar: np.ndarray, wanted: np.ndarray, rows: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int):
    """(query position, row position, score, rounded score) of the k best rows of each query that reach its bar, among the rows of its wanted cells.

    Rows are sorted by their cell. What is held besides a tile of scores is bounded: hits are cut to the k best of each query as they come, and the bars rise.
    """
    bar = bar.copy()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    held = 0
    for begin in range(0, len(rows), TILE_ROWS):
        tile = cells[begin : begin + TILE_ROWS]
        asked = wanted[:, tile[0] : tile[-1] + 1]
        asking = np.flatnonzero(asked.any(axis=1))
        if not len(asking):
            continue
        scores = vectors[asking] @ rows[begin : begin + TILE_ROWS].T
        here = asked[asking][:, tile - tile[0]]
        passing = here & (scores >= (bar[asking] - RANK_SLACK)[:, None])
        if len(tile) > k and np.count_nonzero(passing) > 4 * k * len(asking):
            seen = np.where(here, scores, -np.inf)
            seen.partition(len(tile) - k, axis=1)
            bar[asking] = np.maximum(bar[asking], seen[:, len(tile) - k])
            passing &= scores >= (bar[asking] - RANK_SLACK)[:, None]
        where, at = np.nonzero(passing)
        found.append((asking[where], at + begin, scores[where, at]))
        held += len(where)
        if held > 2 * STEP_HITS:
            where, at, scores, _ = _ranked(*map(np.concatenate, zip(*found)), ids, k)
            last = np.searchsorted(where, where) + k - 1 == np.arange(len(where))
            bar[where[last]] = np.maximum(bar[where[last]], scores[last])
            found, held = [(where, at, scores)], len(where)
    return _ranked(*map(np.concatenate, zip(*found)), ids, k)


def _score_blocks(k: int, blocks: Blocks):
    """Hits of queries (rows that ask) in the block's rows, which come first and by their cell: a task holds one block, and queries stream past."""
    begins = blocks.begins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = None, [], None
        for batch in batches:
            of = batch.column("block").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b == e:
                    continue
                if of[b] != block:
                    block, held, rows = of[b], [], None
                if not asks[b]:
                    held.append(batch.slice(b, e - b).select(["id", "cell", "vector"]))
                    continue
                if rows is None and held:
                    table = pa.Table.from_batches(held)
                    ids, cells, rows, held = table["id"].to_numpy(), table["cell"].to_numpy() - begins[block], _matrix(table["vector"]), []
                    del table
                if rows is None:
                    continue
                step = max(1, min(QUERIES_PER_STEP, STEP_HITS // min(k, len(rows))))
                for begin in range(b, e, step):
                    some = batch.slice(begin, min(step, e - begin))
                    bits = np.frombuffer(b"".join(some.column("cells").to_pylist()), np.uint8).reshape(some.num_rows, -1)
                    wanted = np.unpackbits(bits, axis=1, count=int(begins[block + 1] - begins[block])).astype(bool)
                    where, at, scores, ranked = _best(_matrix(some.column("vector")), some.column("bar").to_numpy(zero_copy_only=False), wanted, rows, cells, ids, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some.column("id").to_numpy()[where]), pa.array(np.full(len(where), block, np.int32)), pa.array(ids[at]), pa.array(scores), pa.array(ranked)],
                        schema=_HITS_ARROW)

    return run


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_hits(rows: DataFrame, blocks: Blocks, calls: DataFrame, k: int) -> DataFrame:
    """The k best ``rows`` (cell, example_id, embedding) in each block for each query, among the cells that its ``calls`` name. Neither side is broadcast or stored."""
    shares = blocks.shares
    held = rows.select(
        looked_up(blocks.of, "cell").alias("block"), F.lit(False).alias("asks"), F.col("example_id").alias("id"),
        F.col("embedding").cast(calls.schema["vector"].dataType).alias("vector"), F.lit(0.0).alias("bar"), "cell", F.lit(None).cast("binary").alias("cells"))
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    asked = calls.select(
        "block", F.lit(True).alias("asks"), F.col("query_id").alias("id"), "vector", "bar", F.lit(-1).alias("cell"), "cells",
        F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int").alias("share"))
    both = held.unionByName(asked).withColumn("task", (F.col("block") * shares + F.col("share")).cast("int"))
    dealt = both.repartitionById((len(blocks.begins) - 1) * shares, "task").sortWithinPartitions("task", "asks", "cell")
    return dealt.select("block", "asks", "id", "vector", "bar", "cell", "cells").mapInArrow(_score_blocks(k, blocks), HITS)


def merge_hits(candidates: DataFrame, k: int, merged_cells: int = MERGED_CELLS) -> DataFrame:
    """Global top-k from the k best of every cell, as a tree: the hits of ``merged_cells`` cells are merged first, so that the last merge of a query gets k from
    each of these groups and not from each cell."""
    by_score = [F.desc("rank_score"), F.asc("example_id")]
    groups = candidates.withColumn("group", (F.col("cell") / merged_cells).cast("int"))
    for by in (["query_id", "group"], ["query_id"]):
        groups = groups.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*by_score))).filter(F.col("rank") <= k)
    return groups.select("query_id", "rank", "example_id", "score")


# -- all rows ranked -------------------------------------------------------------------------------

_RANKED_ARROW = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("example_id", pa.int64()), ("score", pa.float64())])


def _ranking(scores: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Positions by falling rounded score; of equal ones the lower ``place`` is first. Scores that are not numbers are left out."""
    ranked = np.round(scores, RANK_DIGITS)
    order = np.argsort(-ranked)
    ranked = ranked[order]
    if len(ranked) and np.isnan(ranked[-1]):
        order, ranked = order[: np.count_nonzero(~np.isnan(ranked))], ranked[~np.isnan(ranked)]
    same = ranked[1:] == ranked[:-1]
    if same.any():
        group = np.concatenate([[0], np.cumsum(~same)])
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        order[tied] = order[tied][np.lexsort((place[order[tied]], group[tied]))]
    return order


def _rank_rows(length: int, numbers: str, step: int, tile_rows: int, held_bytes: int):
    """Ranked hits of queries (rows that ask) in all rows that come before them, which lie in a file of the task beyond ``held_bytes``; ``step`` queries are scored together."""
    kind = _number(numbers)

    def ranked(query_ids: pa.Array, ids: pa.Array, place: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = max(1, SENT_HITS // len(ids))
        for begin in range(0, len(scores), some):
            orders = [_ranking(own, place) for own in scores[begin : begin + some]]
            sizes = [len(order) for order in orders]
            columns = [
                query_ids.take(pa.array(np.repeat(np.arange(begin, begin + len(orders)), sizes))),
                pa.array(np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes])),
                ids.take(pa.array(np.concatenate(orders))),
                pa.array(np.concatenate([own[order] for own, order in zip(scores[begin : begin + some], orders)])),
            ]
            hits = pa.RecordBatch.from_arrays(columns, schema=_RANKED_ARROW)
            yield from (hits.slice(at, SENT_HITS) for at in range(0, hits.num_rows, SENT_HITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, place = [], None, None
        with tempfile.SpooledTemporaryFile(held_bytes) as vectors:
            for batch in batches:
                asking = int(np.count_nonzero(~batch.column("asks").to_numpy(zero_copy_only=False)))
                if asking:
                    held.append(batch.column("id").slice(0, asking))
                    vectors.write(batch.column("vector").slice(0, asking).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
                for begin in range(asking, batch.num_rows, step):
                    if ids is None:
                        ids = pa.concat_arrays(held)
                        place = np.empty(len(ids), np.int64)
                        place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    some = batch.slice(begin, step)
                    asks, scores = _matrix(some.column("vector")), np.empty((some.num_rows, len(ids)))
                    vectors.seek(0)
                    for at in range(0, len(ids), tile_rows):
                        tile = np.frombuffer(vectors.read(tile_rows * length * kind.itemsize), kind).reshape(-1, length).astype(np.float64)
                        scores[:, at : at + tile_rows] = asks @ tile.T
                    yield from ranked(some.column("id"), ids, place, scores)

    return run


def rank_all(rows: DataFrame, count: int, length: int, queries: DataFrame) -> DataFrame:
    """All ``count`` ``rows`` (example_id, embedding) ranked for each of ``queries`` (query_id, vector), whose ids are unique: (query_id, rank, example_id, score).

    Rows are copied to each task, and queries dealt to them; what moves does not grow with the hits.
    """
    tasks, kind = tasks_of(queries), queries.schema["vector"].dataType
    held = rows.select(F.col("example_id").alias("id"), F.col("embedding").cast(kind).alias("vector"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    asked = queries.select(F.col("query_id").alias("id"), "vector", F.lit(True).alias("asks"), F.pmod(F.xxhash64("query_id"), F.lit(tasks)).cast("int").alias("task"))
    dealt = held.unionByName(asked).repartitionById(tasks, "task").sortWithinPartitions("asks")
    ranks = _rank_rows(length, kind.simpleString(), max(1, RANK_BYTES // (8 * count)), TILE_ROWS, BLOCK_BYTES)
    return dealt.select("asks", "id", "vector").mapInArrow(ranks, "query_id bigint, rank int, example_id bigint, score double")


@dataclass(frozen=True)
class Search:
    """``hits`` (query_id, rank, example_id, score), the usable queries, and the cells that they have visited besides the first one of each."""

    hits: DataFrame
    queries: DataFrame
    visits: DataFrame
    cells: int

    def skipped(self) -> int:
        """How many visits of a query to a cell the bounds have saved."""
        return self.queries.count() * (self.cells - 1) - self.visits.count()


def search_cells(index: CellIndex, queries: DataFrame, k: int | None = None) -> Search:
    """Exact hits of all usable queries, and which cells they have taken.

    Every query looks into one cell at its nearest centroid. The k-th best score there is its bar, and it visits just those other cells whose
    bound reaches the bar. Queries are sent to blocks of cells, once to each. One that asks for as many hits as there are rows has no bar, and looks into all cells at once.
    """
    k = k or DEFAULT_K
    shape, tasks = index.shape, tasks_of(queries)
    numbers = _numbers((index.rows, "embedding"), (queries, "embedding"))
    called = CALLS.format(numbers)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast(numbers).alias("vector")).filter(vector_problem("vector", shape.length).isNull())
    asked = asked.withColumn("bar", F.lit(float("-inf")))
    rows = index.rows.select((looked_up(shape.first, "centroid") + F.col("part")).cast("int").alias("cell"), "example_id", "embedding", "part")
    sizes = shape.sizes
    blocks = gather_cells(sizes, shape.length, tasks)
    others = _wanted(shape, False)
    visits = asked.mapInArrow(visits_of(others), "query_id bigint, cell int")

    def from_all_cells(queries: DataFrame) -> DataFrame:
        return merge_hits(block_hits(rows, blocks, queries.mapInArrow(calls_of(_wanted(shape, None), blocks), called), k), k)

    if k >= shape.rows.sum():
        counted = stored(asked.withColumn("copies", F.count("*").over(Window.partitionBy("query_id"))), "counted-queries")
        hits = rank_all(rows, int(shape.rows.sum()), shape.length, counted.filter("copies = 1").select("query_id", "vector"))
        # Hits of an id that several queries have are ranked together, by Spark: there may be any number of them.
        copied = counted.filter("copies > 1").select(*asked.columns)
        return Search(hits if copied.isEmpty() else hits.unionByName(from_all_cells(copied)), asked, visits, shape.cells)
    if shape.cells == 1:
        return Search(from_all_cells(asked), asked, visits, shape.cells)
    # Homes are first parts, so that no other rows are moved for them.
    homes = gather_cells(np.where(np.isin(np.arange(shape.cells), shape.first), sizes, 0), shape.length, tasks)
    near = stored(block_hits(rows.filter("part = 0"), homes, asked.mapInArrow(calls_of(_wanted(shape, True), homes), called), k), "near-hits")
    bars = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    bar = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf")))
    barred = asked.drop("bar").join(bars.select("query_id", bar.alias("bar")), "query_id")
    far = block_hits(rows, blocks, barred.mapInArrow(calls_of(others, blocks), called), k)
    return Search(merge_hits(near.unionByName(far), k), asked, barred.mapInArrow(visits_of(others), "query_id bigint, cell int"), shape.cells)


_NO_HITS = "query_id bigint, rank int, example_id bigint, score double"


def search(index: DataFrame | CellIndex, queries: DataFrame, k: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` best index rows of every query: (query_id, rank, example_id, score).

    ``index`` has (example_id, embedding) and ``queries`` (query_id, embedding), with unique ids; or the index is dealt to cells already. ``k`` of None or 0
    means 3; fewer index rows give fewer hits. Most index vectors have one length, and what is of another one or cannot be scored has no hits and
    changes nothing for the others: ``rejected_examples`` and ``rejected_queries`` name it.
    """
    cells = index if isinstance(index, CellIndex) else partition_index(index, cell_rows)
    return queries.sparkSession.createDataFrame([], _NO_HITS) if cells is None else search_cells(cells, queries, k).hits


def rejected_queries(index: DataFrame | CellIndex, queries: DataFrame) -> DataFrame:
    """(query_id, error) of the queries that ``search`` leaves out."""
    length = index.shape.length if isinstance(index, CellIndex) else vector_length(index)
    return queries.select("query_id", vector_problem("embedding", length).alias("error")).filter("error is not null")


def rejected_examples(index: DataFrame) -> DataFrame:
    """(example_id, error) of the index rows that ``search`` leaves out."""
    return index.select("example_id", vector_problem("embedding", vector_length(index)).alias("error")).filter("error is not null")


def search_examples(index: DataFrame, queries: DataFrame, k: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Hits with description and code, which join in by id after the top-k is known: texts meet k rows for each query.

    One example can be near to many queries; its texts then go to as many tasks as its share of the hits asks for.
    """
    hits = stored(search(index, queries, k, cell_rows), "hits")
    texts = index.select("example_id", "description", "code")
    return salted_by_count(hits, texts, "example_id", ["query_id"]).select("query_id", "rank", "example_id", "description", "code", "score")
