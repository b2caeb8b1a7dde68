import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import generate as G
from weftline.operators import retrieval as R
from weftline.operators.skew import salted_by_count
from weftline.sources.index import current_version, open_index, read_index, reindex, write_index


def frame(spark, vectors, key="example_id"):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{key} bigint, embedding array<float>"
    ).repartition(4)


def brute_force(index, queries, k):
    out = {}
    scores = np.round(queries.astype(np.float32).astype(float) @ index.astype(np.float32).astype(float).T, 10)
    for q, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        out[q] = best
    return out


def found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.example_id)
        assert r.rank == len(out[r.query_id])
    return out


WAYS = {"one cell": {}, "cells": {"cell_rows": 37}}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k", [1, 3, 50, 400])
def test_search_is_exact(spark, way, k):
    rng = np.random.default_rng(1)
    index, queries = rng.normal(size=(300, 8)), rng.normal(size=(60, 8))
    index[::3] = index[1]  # a third of all rows are copies: ties go to the lower id
    hits = R.search(frame(spark, index), frame(spark, queries, "query_id"), k, **WAYS[way])
    assert found(hits) == brute_force(index, queries, k)


def test_search_in_small_steps(spark, monkeypatch):
    rng = np.random.default_rng(2)
    index, queries = np.round(rng.normal(size=(200, 4)), 1), np.round(rng.normal(size=(20, 4)), 1)
    monkeypatch.setattr(R, "QUERIES_PER_STEP", 7)
    cells = R.partition_index(frame(spark, index), cell_rows=16)
    hits = R.search_cells(cells, frame(spark, queries, "query_id"), 5).hits
    assert found(hits) == brute_force(index, queries, 5)


def test_bounds_skip_cells_and_lose_no_hit(spark):
    """Vectors in tight groups: most cells cannot hold a hit, and are not looked into."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    index = np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(1000, 16))
    queries = centres + 0.05 * rng.normal(size=(20, 16))
    cells = R.partition_index(frame(spark, index), cell_rows=25)
    found_cells = R.search_cells(cells, frame(spark, queries, "query_id"), 5)
    assert found(found_cells.hits) == brute_force(index, queries, 5)
    assert found_cells.cells >= 40 and found_cells.skipped() > 0.8 * 20 * (found_cells.cells - 1)
    # Vectors without any order: nothing can be skipped, and all is found.
    index, queries = rng.normal(size=(300, 16)) * rng.uniform(0, 3, (300, 1)), rng.normal(size=(30, 16))
    loose = R.search_cells(R.partition_index(frame(spark, index), cell_rows=20), frame(spark, queries, "query_id"), 5)
    assert found(loose.hits) == brute_force(index, queries, 5)


def test_a_hot_cell_is_held_in_parts(spark):
    """A third of the vectors are one: their cell is dealt by id, and no task holds more than about a cell."""
    vectors = np.random.default_rng(3).normal(size=(900, 6))
    vectors[::3] = vectors[0]
    cells = R.partition_index(frame(spark, vectors), cell_rows=50)
    sizes = [r["count"] for r in cells.rows.groupBy("centroid", "part").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 100
    assert found(R.search(cells, frame(spark, vectors[:40], "query_id"), 4)) == brute_force(vectors, vectors[:40], 4)


def test_merge_is_a_tree(spark):
    """Of 64 cells with 3 hits each, the last merge of a query gets 3 from each of 4 groups."""
    rows = spark.range(64 * 3 * 5).select(
        (F.col("id") % 5).alias("query_id"), (F.col("id") % 64).cast("int").alias("cell"), F.col("id").alias("example_id"),
        (F.xxhash64("id") / 2.0**64).alias("score")).withColumn("rank_score", F.col("score"))
    merged = R.merge_hits(rows, 3, merged_cells=16)
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit [query_id") == 4 and merged.count() == 15
    want = {r.query_id: r.top for r in rows.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 3).alias("top")).collect()}
    for q, top in want.items():
        assert [r.score for r in merged.filter(f"query_id = {q}").orderBy("rank").collect()] == top
    groups = rows.withColumn("group", (F.col("cell") / 16).cast("int"))
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "group").orderBy(F.desc("score")))).filter("r <= 3")
    assert ranked.count() == 5 * 4 * 3 < rows.count() / 4


def test_bad_index_rows_are_named(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [])]
    index = spark.createDataFrame(rows, "example_id bigint, embedding array<float>")
    # The length is that of most rows, not of the first one met.
    errors = {r.example_id: r.error for r in R.rejected_examples(index).collect()}
    assert sorted(errors) == [3, 4, 5, 6, 7] and "length 1, expected 2" in errors[4]
    assert found(R.search(index, frame(spark, [[1, 0]], "query_id"), 9)) == {0: [1, 2]}


def test_an_example_near_to_all_is_spread(spark):
    hits = spark.range(3000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("example_id"))
    texts = spark.range(3000).select(F.col("id").alias("example_id"), F.lit("d").alias("description"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_by_count(hits, texts, "example_id", ["query_id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(sizes) == 3000 and max(sizes) < 1000


@pytest.mark.parametrize("way", WAYS)
def test_default_k_few_rows_and_no_queries(spark, way):
    vectors = np.eye(4)
    index = frame(spark, vectors)
    assert {len(v) for v in found(R.search(index, frame(spark, vectors, "query_id"), 0, **WAYS[way])).values()} == {3}
    assert {len(v) for v in found(R.search(index, frame(spark, vectors, "query_id"), 9, **WAYS[way])).values()} == {4}
    none = frame(spark, vectors, "query_id").filter("query_id < 0")
    assert R.search(index, none, **WAYS[way]).collect() == []
    assert R.search(index.filter("example_id < 0"), frame(spark, vectors, "query_id"), **WAYS[way]).collect() == []


def test_top_hit_of_a_vector_is_itself(spark):
    rng = np.random.default_rng(3)
    index = R.build_index(frame(spark, rng.normal(size=(50, 6))).withColumns(
        {"description": F.lit("d"), "code": F.lit("c")}))
    hits = R.search(index, index.select(F.col("example_id").alias("query_id"), "embedding"), 1)
    assert all(r.query_id == r.example_id and abs(r.score - 1) < 1e-6 for r in hits.collect())


def test_blocks_when_index_and_queries_share_a_table(spark):
    vectors = np.random.default_rng(4).normal(size=(80, 5))
    table = frame(spark, vectors)
    some = table.join(spark.range(0, 80, 2).select(F.col("id").alias("example_id")), "example_id", "left_semi")
    queries = table.select(F.col("example_id").alias("query_id"), "embedding")
    got = found(R.search(some, queries, 3, cell_rows=16))
    want = brute_force(vectors[::2], vectors, 3)
    assert got == {q: [2 * i for i in ids] for q, ids in want.items()}


def test_index_vectors(spark):
    df = frame(spark, [[3, 4], [0, 0]]).withColumns({"description": F.lit("d"), "code": F.lit("c")})
    rows = {r.example_id: r.embedding for r in R.build_index(df).collect()}
    assert rows[0] == pytest.approx([0.6, 0.8]) and rows[1] == [0.0, 0.0]
    mixed = spark.createDataFrame([(1, [1.0, 2.0], "d", "c"), (2, [1.0], "d", "c")],
                                  "example_id bigint, embedding array<float>, description string, code string")
    with pytest.raises(Exception, match="vector length"):
        R.build_index(mixed).collect()


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("bad_first", [True, False])
def test_bad_queries_are_named_and_the_others_keep_their_hits(spark, way, bad_first):
    bad = [(100, None), (101, []), (102, [1.0]), (103, [float("nan"), 0.0, 0.0]), (104, [None, 1.0, 0.0]), (105, [float("inf"), 0.0, 0.0])]
    good = [(i, [float(x) for x in row]) for i, row in enumerate(np.eye(3))]
    queries = spark.createDataFrame(bad + good if bad_first else good + bad, "query_id bigint, embedding array<float>").coalesce(1)
    index = frame(spark, np.eye(3))
    assert {q: e[0] for q, e in found(R.search(index, queries, 3, **WAYS[way])).items()} == {0: 0, 1: 1, 2: 2}
    errors = {r.query_id: r.error for r in R.rejected_queries(index, queries).collect()}
    assert sorted(errors) == [q for q, _ in bad] and "length 1, expected 3" in errors[102] and errors[100] == "no vector"


@pytest.mark.parametrize("way", WAYS)
def test_index_vectors_that_are_not_numbers_hide_no_others(spark, way):
    vectors = np.random.default_rng(5).normal(size=(200, 4))
    broken = vectors.copy()
    broken[:3] = np.nan
    got = found(R.search(frame(spark, broken).coalesce(1), frame(spark, vectors, "query_id"), 3, **WAYS[way]))
    assert got == {q: [e + 3 for e in ids] for q, ids in brute_force(vectors[3:], vectors, 3).items()}


def test_an_index_takes_vectors_of_one_length_whatever_comes_first(spark, tmp_path):
    schema = "example_id bigint, embedding array<float>, description string, code string"
    for rows in ([(1, None), (2, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], [(1, [float("nan")])]):
        with pytest.raises(Exception, match="vector"):
            R.build_index(spark.createDataFrame([(*r, "d", "c") for r in rows], schema)).collect()
    path = str(tmp_path / "index")
    write_index(R.build_index(spark.createDataFrame([(1, [1.0, 2.0], "d", "c")], schema)), path)
    with pytest.raises(Exception, match="expected 2"):
        write_index(R.build_index(spark.createDataFrame([(2, [1.0, 2.0, 3.0], "d", "c")], schema)), path, append=True)


def test_index_table_and_reindex(spark, tmp_path):
    path = str(tmp_path / "deep" / "index")
    examples = frame(spark, np.eye(6)).withColumns({"description": F.col("example_id").cast("string"),
                                                    "code": F.lit("c")})
    write_index(R.build_index(examples.filter("example_id < 4")), path)
    new = R.new_examples(examples, read_index(spark, path))
    assert sorted(r.example_id for r in new.collect()) == [4, 5]
    write_index(R.build_index(new), path, append=True)
    hits = R.search_examples(read_index(spark, path), frame(spark, np.eye(6), "query_id"), 1)
    assert {r.query_id: r.description for r in hits.collect()} == {i: str(i) for i in range(6)}


def test_embedding_function_batches(spark):
    df = spark.createDataFrame([(i, "a b a " * i) for i in range(10)], "id bigint, description string")
    rows = G.embed(df, make_model=G.hashed_words(16), batch_size=3).orderBy("id").collect()
    assert [sum(r.embedding) for r in rows] == [3 * i for i in range(10)] and len(rows[0].embedding) == 16


def test_reindex_renews_what_changed_and_switches_at_the_end(spark, tmp_path):
    path = str(tmp_path / "versions")
    asked = []

    def embed(stale):
        asked.append(sorted(r.example_id for r in stale.collect()))
        return stale.withColumn("embedding", F.array(F.length("description").cast("float"), F.lit(1.0).cast("float")))

    def examples(**texts):
        return spark.createDataFrame([(int(k[1:]), v, "c") for k, v in texts.items()], "example_id bigint, description string, code string")

    def rows(version=None):
        return {r.example_id: (r.description, r.since, round(r.embedding[0] / r.embedding[1])) for r in open_index(spark, path, version).collect()}

    assert current_version(spark, path) == 0 and open_index(spark, path).count() == 0
    assert reindex(examples(e1="a", e2="bb", e3="ccc"), path, embed) == 1
    assert reindex(examples(e1="a", e2="bbbb", e4="d"), path, embed, tombstones=spark.createDataFrame([(3,), (4,), (9,)], "example_id int")) == 2
    assert asked == [[1, 2, 3], [2, 4]]
    assert rows() == {1: ("a", 1, 1), 2: ("bbbb", 2, 4), 4: ("d", 2, 1)}
    assert rows(1) == {1: ("a", 1, 1), 2: ("bb", 1, 2), 3: ("ccc", 1, 3)}
    # A run that fails while it writes leaves the version before readable, and the next run takes its place.
    with pytest.raises(Exception, match="vector length"):
        reindex(examples(e5="e"), path, lambda stale: stale.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert current_version(spark, path) == 2 and len(rows()) == 3
    assert reindex(examples(e5="e"), path, embed) == 3 and sorted(rows()) == [1, 2, 4, 5]


def test_queries_go_once_to_each_block_whatever_the_cells_are(spark):
    """300 rows in cells of about 4: a query is moved once for each block, not for each of the cells that it looks into."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 8))
    cells = R.partition_index(frame(spark, vectors), cell_rows=4)
    blocks = R.gather_cells(cells.shape.sizes, 8, 8)
    assert cells.shape.cells > 60 and len(blocks.begins) - 1 <= 4 and blocks.begins[-1] == cells.shape.cells
    asked = frame(spark, vectors[:20], "query_id").select("query_id", F.col("embedding").alias("vector"), F.lit(float("-inf")).alias("bar"))
    calls = asked.mapInArrow(R.calls_of(R._wanted(cells.shape, False), blocks), R.CALLS.format("array<float>"))
    visits = asked.mapInArrow(R.visits_of(R._wanted(cells.shape, False)), "query_id bigint, cell int")
    assert calls.count() <= 20 * (len(blocks.begins) - 1)
    assert sum(bin(int.from_bytes(r.cells, 'big')).count('1') for r in calls.collect()) == visits.count()
    assert visits.count() == 20 * (cells.shape.cells - 1)


@pytest.mark.parametrize("k", [1, 7, 90])
def test_hits_are_cut_as_they_come(k, monkeypatch):
    """Tiles of 16 rows and few hits held: the same hits as from all scores at once, of the wanted cells only."""
    monkeypatch.setattr(R, "TILE_ROWS", 16)
    monkeypatch.setattr(R, "STEP_HITS", 40)
    rng = np.random.default_rng(9)
    rows, asks = np.round(rng.normal(size=(100, 3)), 1), np.round(rng.normal(size=(6, 3)), 1)
    cells, wanted, ids = np.sort(rng.integers(0, 9, 100)), rng.random((6, 9)) < 0.6, rng.permutation(100)
    where, at, _, _ = R._best(asks, np.full(6, -np.inf), wanted, rows, cells, ids, k)
    scores = np.round(asks @ rows.T, 10)
    for q in range(6):
        want = sorted((i for i in range(100) if wanted[q, cells[i]]), key=lambda i: (-scores[q, i], ids[i]))[:k]
        assert at[where == q].tolist() == want


def test_k_beyond_the_index_ranks_every_pair(spark, tmp_path):
    from weftline.plans import QUERIES

    vectors = np.random.default_rng(8).normal(size=(30, 4))
    frame(spark, vectors, "vec_id").withColumn("label", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert found(QUERIES["r06_k_beyond_index"](spark, str(tmp_path))) == brute_force(vectors, vectors, 30)


@pytest.mark.parametrize("kind,last_id,query_ids", [("float", None, [*range(19), None]), ("double", 49, [*range(17), 5, 5, 17])])
def test_all_rows_ranked_a_few_queries_at_a_time(spark, kind, last_id, query_ids, monkeypatch):
    """Two queries at a time meet tiles of a few rows, which lie in a file: every pair is ranked, ties go to the lower id, a missing id is last, and hits of a repeated query id are ranked together."""
    monkeypatch.setattr(R, "TILE_ROWS", 7)
    monkeypatch.setattr(R, "BLOCK_BYTES", 100)
    monkeypatch.setattr(R, "RANK_BYTES", 8 * 50 * 2)
    rng = np.random.default_rng(10)
    index, asks = np.round(rng.normal(size=(50, 3)), 1).astype(np.float32), np.round(rng.normal(size=(20, 3)), 1).astype(np.float32)
    index[::4] = index[1]
    ids = [*rng.permutation(49).tolist(), last_id]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, index)], f"example_id bigint, embedding array<{kind}>").repartition(3)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(query_ids, asks)], f"query_id bigint, embedding array<{kind}>").repartition(3)
    got, want = {}, {}
    for r in R.search(rows, queries, 1000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.example_id, round(r.score, 10)))
    for q, own in zip(query_ids, asks.astype(float) @ index.astype(float).T):
        want.setdefault(q, []).extend((-round(score, 10), i is None, i) for i, score in zip(ids, own))
    assert {q: sorted(hits) for q, hits in got.items()} == {q: [(rank, i, -score) for rank, (score, _, i) in enumerate(sorted(hits), 1)] for q, hits in want.items()}


def test_scores_in_place_of_numbers_are_ranked_as_before():
    scores = np.array([0.5, np.nan, np.inf, -0.0, 0.0, -np.inf, 0.5])
    assert R._ranking(scores, np.arange(6, -1, -1)).tolist() == [2, 6, 0, 4, 3, 5]


def test_six_digits_are_those_of_round(spark):
    from weftline.plans.retrieval_queries import _six

    rng = np.random.default_rng(11)
    values = [0.0, -0.0, 0.5, 1.0000005, -1.0000005, 2.5e-7, 5e-7, -5e-7, 1e-300, 1234.5678905, 1e3, 1e17, -1e300, float("inf"), float("-inf"), float("nan"), None]
    values += [*rng.normal(size=2000), *(np.arange(-500, 500) / 1e6 + 5e-7), *(rng.integers(-10**6, 10**6, 1000) / 2e6), *(rng.normal(size=200) * 1e6)]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "score double").withColumn("want", F.round("score", 6))
    assert df.transform(_six).filter("not (score <=> want) or string(score) != string(want)").count() == 0
