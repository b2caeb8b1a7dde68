"""Hard negatives of anchors, by candidate lists that the anchors of a cluster share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.cells import BLOCK_ROWS, Rows, best, in_cells, matrix, numbered, over_cells, products, usable, whole_numbers
from weftline.llm.common import stored

# Clusters of anchors, anchors that their centres are learnt from at most, and rounds of learning.
CLUSTERS, SAMPLE, ROUNDS = 64, 8192, 8
# Candidates that are looked at together while a list is walked.
STRIDE = 1024

POSITIVES = "anchor_row long, score long, found_id long, found_row long"
NEGATIVES = "anchor_row long, slot int, score long, found_id long, found_row long"


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in ddl.split(", ")])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _cosines(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = min(vectors.shape[1], centres.shape[1])
    return np.clip(_unit(vectors)[:, :width] @ centres[:, :width].T, -1.0, 1.0)


def learn_centres(anchors: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> np.ndarray:
    """Directions of cluster centres, by spherical k-means on ``sample`` anchors at most (those with the least hash). They decide how long the walks are, and nothing else."""
    drawn = matrix(anchors.orderBy(F.xxhash64("row"), "row").select("vector").limit(sample).toArrow()["vector"])
    units = _unit(drawn)
    units = units[(units != 0).any(axis=1)]
    if not len(units):
        return np.zeros((1, max(1, drawn.shape[1])))
    centres = units[:: max(1, len(units) // clusters)][:clusters]
    for _ in range(ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        centres = np.where((sums != 0).any(axis=1, keepdims=True), _unit(sums), centres)
    return centres


def _clustered(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Anchors with ``turn``, their cluster, and ``angle``, the widest angle between the cluster's centre and an anchor of it."""
    columns = [*anchors.columns, "turn", "angle"]

    def assign(batches):
        for batch in batches:
            cosines = _cosines(matrix(batch.column("vector")), centres)
            nearest = cosines.argmax(axis=1)
            angles = np.arccos(cosines[np.arange(len(nearest)), nearest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int64)), pa.array(angles)], columns)

    fields = ", ".join(f"{c} {t}" for c, t in anchors.dtypes)
    near = stored(anchors.mapInArrow(assign, f"{fields}, turn long, angle double"), "anchor-clusters")
    # One row for each cluster, ``clusters`` at most.
    widest = near.groupBy("turn").agg(F.max("angle").alias("angle"))
    return near.drop("angle").join(F.broadcast(widest), "turn")


class Lists:
    """A block of candidates and, for the cluster at hand, the list of them by falling upper bound of their products with unit anchors of the cluster."""

    def __init__(self, centres: np.ndarray, rows: Rows) -> None:
        self.centres, self.rows, self.cluster = centres, rows, None
        self.lengths = np.linalg.norm(rows.vectors.astype(np.float64), axis=1)
        self.labels = rows.table["label"].to_numpy()
        self.places = {int(r): i for i, r in enumerate(rows.row.tolist())}

    def of(self, anchors: Rows) -> tuple[np.ndarray, np.ndarray]:
        """(order, bounds) of the list of the anchors' cluster; it is sorted once and shared by all of them."""
        cluster = anchors.table["turn"][0].as_py()
        if cluster != self.cluster:
            angles = np.arccos(_cosines(self.rows.vectors, self.centres[cluster : cluster + 1])[:, 0])
            bounds = self.lengths * np.cos(np.maximum(angles - anchors.table["angle"][0].as_py(), 0.0))
            self.order = np.argsort(-bounds, kind="stable")
            # Rounding must not make a bound too small.
            self.bounds = bounds[self.order] + 1e-6 * (1.0 + self.lengths.max(initial=0.0))
            self.cluster = cluster
        return self.order, self.bounds


def _walk(lists: Lists, anchors: Rows, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """(slot, score, candidate) of the ``k`` best candidates of each slot: of anchor ``owner``, with a score from ``low`` to ``high``, and with the anchor's label or another one.

    The list is walked from its greatest bound down. A slot is done when no bound that is left reaches its k-th best score, or its lowest score.
    """
    order, bounds = lists.of(anchors)
    labels = anchors.table["label"].to_numpy()
    own = np.array([lists.places.get(int(r), -1) for r in anchors.row])
    lengths = np.linalg.norm(anchors.vectors.astype(np.float64), axis=1)[owner]
    slots, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bar = low.astype(np.float64)
    live = np.flatnonzero(high >= low)
    for first in range(0, len(order), STRIDE):
        live = live[bounds[first] * lengths[live] + 1e-6 >= bar[live]]
        if not len(live):
            break
        here = order[first : first + STRIDE]
        who, back = np.unique(owner[live], return_inverse=True)
        product = products(anchors.vectors[who], lists.rows.vectors[here]).astype(np.int64)
        fits = (labels[who][:, None] == lists.labels[here][None, :]) == same
        fits &= own[who][:, None] != here[None, :]
        found = product[back]
        passing = fits[back] & (found >= bar[live][:, None]) & (found <= high[live][:, None])
        if found.shape[1] > k:
            floor = np.iinfo(np.int64).min
            masked = np.where(passing, found, floor)
            passing &= masked >= np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k][:, None]
        s, c = np.nonzero(passing)
        if not len(s):
            continue
        slots, scores, at = np.concatenate([slots, live[s]]), np.concatenate([scores, found[s, c]]), np.concatenate([at, here[c]])
        kept = best(slots, scores, lists.rows, at, k)
        slots, scores, at = slots[kept], scores[kept], at[kept]
        full, starts, counts = np.unique(slots, return_index=True, return_counts=True)
        full, starts = full[counts == k], starts[counts == k]
        bar[full] = np.maximum(bar[full], scores[starts + k - 1])
    return slots, scores, at


def _hits(ddl: str, *columns: np.ndarray, lists: Lists, at: np.ndarray) -> pa.RecordBatch:
    schema = _schema(ddl)
    arrays = [pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(columns, schema)]
    found = [pa.array(lists.rows.id[at], mask=lists.rows.unnamed[at]), pa.array(lists.rows.row[at])]
    return pa.RecordBatch.from_arrays([*arrays, *found], schema=schema)


def _positives(k: int) -> Callable[[Lists, Rows], pa.RecordBatch]:
    def run(lists: Lists, anchors: Rows) -> pa.RecordBatch:
        n = len(anchors)
        limits = np.full(n, -(2**62)), np.full(n, 2**62)
        slots, scores, at = _walk(lists, anchors, np.arange(n), *limits, True, k)
        return _hits(POSITIVES, anchors.row[slots], scores, lists=lists, at=at)

    return run


def _negatives(k: int, least: int, most: int) -> Callable[[Lists, Rows], pa.RecordBatch]:
    def run(lists: Lists, anchors: Rows) -> pa.RecordBatch:
        wanted = anchors.table["wanted"].combine_chunks()
        sizes = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(anchors)), sizes)
        slot = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        positive = wanted.flatten().to_numpy(zero_copy_only=False)
        low, high = -((-least * positive) // 100), (most * positive) // 100
        slots, scores, at = _walk(lists, anchors, owner, low, high, False, k)
        return _hits(NEGATIVES, anchors.row[owner[slots]], slot[slots], scores, lists=lists, at=at)

    return run


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
    block_rows: int = BLOCK_ROWS, clusters: int = CLUSTERS,
) -> DataFrame:
    """For each anchor and each of its positives, the hardest negatives among ``vectors`` (vec_id, embedding, label).

    Returns anchor_id, positive_id, rank, negative_id, positive_score and negative_score. Scores are exact inner products of whole numbers floor(scale * x). An
    anchor's positives are its ``positives`` best other rows of the same label. Negatives have another label and a score between ``least`` and
    ``most`` percent of the positive's; the ``negatives`` best of these are returned. Ties go to the smaller vec_id. All limits count fewer rows where there are fewer.

    Anchors are clustered. The rows are dealt to blocks of about ``block_rows``, and anchors stream past each block, cluster by cluster. For a cluster, the block's
    candidates are sorted once by an upper bound that holds for all its anchors: length times the cosine of the angle to the centre less the widest angle of an
    anchor. Each anchor walks that list until the bound proves that nothing better follows. Positives are ranked over all blocks
    before negatives are sought. Centres are learnt on a bounded sample; they change the length of the walks, not what is found.

    Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths are compared as if the shorter one ended in
    zeros. Null ids rank last among equals. Rows that repeat stay apart, so each anchor row is answered. No anchors, no positives or no negatives give no rows.
    Other columns are not read. Components too large for scores of 56 bits stop the job.
    """
    rows = vectors.filter(usable("embedding") & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole_numbers("embedding", scale).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = numbered(rows, "labelled-vectors")
    anchors = rows.filter("asks").drop("asks")
    centres = learn_centres(anchors, clusters)
    none = F.array().cast("array<long>")
    held = rows.select(*anchors.columns, F.lit(0).cast("long").alias("turn"), F.lit(0.0).alias("angle"), none.alias("wanted"))
    asked = _clustered(anchors, centres).select(*anchors.columns, "turn", "angle")
    lists = lambda block: Lists(centres, block)

    cells = in_cells(held, asked.withColumn("wanted", none), block_rows)
    found = cells.mapInArrow(over_cells(lists, _positives(positives), turns=True), POSITIVES)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_row")
    found = found.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < positives)
    found = stored(found.select("anchor_row", "slot", F.col("score").alias("positive_score"), F.col("found_id").alias("positive_id")), "positives")

    # ``positives`` scores at most in a list.
    listed = found.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("list"))
    wanted = listed.select(F.col("anchor_row").alias("row"), F.col("list.positive_score").alias("wanted"))
    cells = in_cells(held, asked.join(wanted, "row").select(*held.columns), block_rows)
    hard = cells.mapInArrow(over_cells(lists, _negatives(negatives, least, most), turns=True), NEGATIVES)
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_row")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return hard.join(found, ["anchor_row", "slot"]).join(names, "anchor_row").select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
