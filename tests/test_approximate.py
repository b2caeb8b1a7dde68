import numpy as np
import pytest

from tests.test_retrieval import brute_force, found, frame
from weftline.operators import approximate as A
from weftline.operators import retrieval as R


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def grouped(rng, groups, each, dim, noise):
    centres = unit(rng.normal(size=(groups, dim)))
    return unit(np.repeat(centres, each, axis=0) + noise * rng.normal(size=(groups * each, dim)))


@pytest.mark.parametrize("k", [1, 5, 400])
def test_recall_of_one_is_exact(spark, k):
    rng = np.random.default_rng(3)
    index, queries = unit(rng.normal(size=(300, 8))), unit(rng.normal(size=(40, 8)))
    index[::3] = index[1]  # a third of all rows are copies, in one bucket of several cells
    buckets = A.bucket_index(frame(spark, index), cell_rows=20)
    assert buckets.shape.parts.max() > 3
    hits = A.search_buckets(buckets, frame(spark, queries, "query_id"), k, recall=1.0).hits
    assert found(hits) == brute_force(index, queries, k)


@pytest.mark.parametrize("shape", ["groups", "noise"])
def test_recall_against_brute_force(spark, shape):
    rng = np.random.default_rng(11)
    index = grouped(rng, 60, 25, 24, 0.1) if shape == "groups" else unit(rng.normal(size=(1500, 24)))
    queries = unit(index[::10] + 0.02 * rng.normal(size=(150, 24)))
    probed = A.search_buckets(A.bucket_index(frame(spark, index), cell_rows=30), frame(spark, queries, "query_id"), 10)
    got, exact = found(probed.hits), brute_force(index, queries, 10)
    assert sum(len(set(got[q]) & set(exact[q])) for q in exact) >= 0.9 * 10 * len(exact)
    share = probed.visited_share()
    assert share < (0.5 if shape == "groups" else 1.0), share
    scores = queries.astype(np.float32).astype(float) @ index.astype(np.float32).astype(float).T
    assert all(abs(r.score - scores[r.query_id, r.example_id]) < 1e-9 for r in probed.hits.collect())


def test_cells_are_looked_into_once(spark):
    rng = np.random.default_rng(5)
    index = unit(rng.normal(size=(400, 8)))
    probed = A.search_buckets(A.bucket_index(frame(spark, index), cell_rows=16), frame(spark, index[:50], "query_id"), 30, recall=0.9)
    assert probed.visits.count() == probed.visits.distinct().count()
    assert probed.hits.groupBy("query_id").count().filter("count != 30").count() == 0


def test_bad_rows_no_rows_and_zero_vectors(spark):
    nothing = spark.createDataFrame([], "example_id bigint, embedding array<float>")
    ask = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert A.search_approximately(nothing, ask).count() == 0
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "example_id bigint, embedding array<float>")
    assert found(A.search_approximately(index, ask, 2, cell_rows=1)) == {1: [1, 2], 4: [1, 2]}
    assert A.search_approximately(index, ask.limit(0)).count() == 0
    with pytest.raises(ValueError):
        A.search_approximately(index, ask, recall=0.0)


def test_recall_counts(spark):
    exact = spark.createDataFrame([(1, 1, 5, 1.0), (1, 2, 6, 0.5)], "query_id bigint, rank int, example_id bigint, score double")
    assert tuple(A.recall_of(exact.limit(0), exact).first()) == (2, 0)
    assert tuple(A.recall_of(exact, exact).first()) == (2, 2)
    assert R.DEFAULT_K == 3
