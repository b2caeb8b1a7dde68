"""Retrieval, generation and streaming operators over the vectors and their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.prompts import DEFAULT_WORDING
from weftline.operators import approximate as A
from weftline.operators import generate as G
from weftline.operators import retrieval as R
from weftline.plans.corpus import (
    INDEXED_SQL, TOP3_SQL, event_requests, indexed_examples, sql_tokens,
)
from weftline.plans.dataset_queries import CHECKED_REQUESTS_SQL
from weftline.plans.registry import Tables, query
from weftline.plans.scoring_queries import quoted
from weftline.session import scratch_path
from weftline.sources.index import open_index, read_index, reindex, write_index
from weftline.streaming.requests import prompt_stream, read_request_stream, validate_stream

W = DEFAULT_WORDING


def with_hits(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([INDEXED_SQL, TOP3_SQL, *ctes])}\n{select}"


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("example_id"), "embedding")


def _as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("example_id").alias("query_id"), "embedding")


def _six(hits: DataFrame) -> DataFrame:
    """Scores rounded to six digits. ``round`` goes by way of decimal text, so it is asked only about scores that are near to halfway or large."""
    millionths = F.col("score") * 1e6
    clear = (F.abs(millionths) < 1e9) & (F.abs(millionths - F.floor(millionths) - 0.5) > 1e-3)
    return hits.withColumn("score", F.when(clear, F.floor(millionths + 0.5) / 1e6).otherwise(F.round("score", 6)))


# -- index -------------------------------------------------------------------------------------------

_MD5_BUCKET = "(('0x' || substr(md5(w), 1, 8))::BIGINT % 64)"


@query("r01_embed_texts", f"""
SELECT doc_id, array_to_string(list_transform(range(64), lambda b: coalesce(m[b], 0)), ',') AS vector FROM (
  SELECT doc_id, map_from_entries(list((bucket, n))) AS m FROM (
    SELECT doc_id, {_MD5_BUCKET} AS bucket, count(*) AS n
    FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS w FROM documents) GROUP BY ALL)
  GROUP BY doc_id)""")
def r01(t: Tables) -> DataFrame:
    """Hashed word counts of all documents (none is without words)."""
    counts = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return G.embed(t.documents, "text").select("doc_id", F.array_join(counts, ",").alias("vector"))


@query("r01_weighted_words", f"""
WITH counts AS (
  SELECT doc_id, bucket, count(*) AS n FROM (
    SELECT doc_id, {_MD5_BUCKET} AS bucket FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS w FROM documents)) GROUP BY ALL),
worth AS (SELECT bucket, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) AS weight FROM counts GROUP BY 1),
weighted AS (SELECT doc_id, bucket, n * weight AS x FROM counts JOIN worth USING (bucket)),
lengths AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM weighted GROUP BY 1)
SELECT doc_id, count(*) FILTER (x > 0) AS n_buckets, round(max((x / size)::FLOAT::DOUBLE), 5) AS greatest, round(sum((x / size)::FLOAT::DOUBLE), 4) AS total
FROM weighted JOIN lengths USING (doc_id) GROUP BY 1""")
def r01_weighted(t: Tables) -> DataFrame:
    """Unit vectors in which words that few documents use weigh more."""
    vectors = G.embed_weighted(t.documents.select("doc_id", "text"), "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors.select(
        "doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n_buckets"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("greatest"), F.round(total, 4).alias("total"))


@query("r02_l2_normalize", """
SELECT vec_id, array_to_string(list_transform(v, lambda x:
  round((x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE * 100000)::BIGINT), ',') AS unit
FROM (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE * i) AS v FROM embeddings)""")
def r02(t: Tables) -> DataFrame:
    """Vectors stretched by position and normalised again, in hundred-thousandths."""
    stretched = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    whole = F.transform(R.l2_normalize("v"), lambda x: F.round(x.cast("double") * 100000).cast("bigint").cast("string"))
    return t.embeddings.select("vec_id", stretched.alias("v")).select("vec_id", F.array_join(whole, ",").alias("unit"))


@query("r03_build_index", f"""
WITH {INDEXED_SQL}
SELECT example_id, md5(description) AS description, code, len(v) AS dim, true AS is_unit FROM indexed""")
def r03(t: Tables) -> DataFrame:
    index = R.build_index(indexed_examples(t))
    is_unit = F.abs(R.inner_product("embedding", "embedding") - 1) < 1e-5
    return index.select(
        "example_id", F.md5("description").alias("description"), "code", F.size("embedding").alias("dim"),
        is_unit.alias("is_unit"),
    )


def _stored_index(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "index")
    write_index(R.build_index(indexed_examples(t)), path)
    return read_index(t.spark, path)


_STORED_SQL = f"""
WITH {INDEXED_SQL} SELECT example_id, md5(description) AS description, code FROM indexed"""


@query("s11_write_index", _STORED_SQL)
def s11(t: Tables) -> DataFrame:
    return _stored_index(t).select("example_id", F.md5("description").alias("description"), "code")


@query("s12_read_index", f"""
WITH {INDEXED_SQL} SELECT example_id, code, len(v) AS dim FROM indexed""")
def s12(t: Tables) -> DataFrame:
    return _stored_index(t).select("example_id", "code", F.size("embedding").alias("dim"))


@query("r09_reindex_new", _STORED_SQL)
def r09(t: Tables) -> DataFrame:
    """Index the documents labelled so far, then add all that are missing: the index is complete."""
    path = scratch_path(t.spark, "index")
    examples = indexed_examples(t)
    labelled = examples.join(t.labels, F.col("example_id") == F.col("doc_id"), "left_semi")
    write_index(R.build_index(labelled), path)
    write_index(R.build_index(R.new_examples(examples, read_index(t.spark, path))), path, append=True)
    return read_index(t.spark, path).select("example_id", F.md5("description").alias("description"), "code")


@query("r09_reindex_changed", f"""
WITH {INDEXED_SQL}
SELECT example_id, md5(description) AS description, code, CASE WHEN example_id % 3 = 0 OR example_id % 5 = 0 THEN 2 ELSE 1 END AS since FROM indexed
UNION ALL SELECT -1 - example_id, md5(description), code, 1 FROM indexed WHERE example_id % 7 = 1""")
def r09_changed(t: Tables) -> DataFrame:
    """A first version with old texts (every third), without some (every fifth) and with others that have gone since; of these, some are named as gone."""
    path = scratch_path(t.spark, "index")
    examples = indexed_examples(t)
    old = F.when(F.col("example_id") % 3 == 0, F.concat(F.lit("old "), F.col("description"))).otherwise(F.col("description"))
    first = examples.withColumn("description", old).filter(F.col("example_id") % 5 != 0)
    passing = examples.filter(F.col("example_id") % 7 < 2).withColumn("example_id", -1 - F.col("example_id"))
    as_is = lambda stale: stale  # noqa: E731  (the vectors are there already)
    reindex(first.unionByName(passing), path, as_is)
    reindex(examples, path, as_is, tombstones=passing.filter((-1 - F.col("example_id")) % 7 == 0))
    return open_index(t.spark, path).select("example_id", F.md5("description").alias("description"), "code", "since")


# -- search --------------------------------------------------------------------------------------------


@query("r04_inner_product", """
SELECT a.vec_id, round(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE),
  list_transform(b.embedding, lambda x: x::DOUBLE)), 9) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def r04(t: Tables) -> DataFrame:
    """Each vector with the next one."""
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(following, "vec_id").select(
        "vec_id", F.round(R.inner_product("embedding", "b"), 9).alias("score")
    )


_ALL_PAIRS_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS example_id, list_dot_product(q.v, i.v) AS score FROM v q, v i)
SELECT query_id, rank, example_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, example_id) AS rank FROM pairs)
WHERE rank <= """


@query("r05_topk", _ALL_PAIRS_SQL + "3")
def r05(t: Tables) -> DataFrame:
    vectors = _vectors(t)
    return _six(R.search(vectors, _as_queries(vectors)))


@query("r06_k_beyond_index", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS example_id, list_dot_product(q.v, i.v) AS score FROM v q, v i)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, example_id) AS rank, example_id,
  round(score, 6) AS score FROM pairs""")
def r06(t: Tables) -> DataFrame:
    """Every vector asks for more hits than there are vectors, and gets all of them ranked: as many rows as there are pairs."""
    vectors = _vectors(t)
    return _six(R.search(vectors, _as_queries(vectors), k=1_000_000_000))


@query("r07_hits_with_examples", with_hits("""
SELECT query_id, rank, example_id, md5(description) AS description, code, round(score, 6) AS score FROM hits"""))
def r07(t: Tables) -> DataFrame:
    index = indexed_examples(t)
    return _six(R.search_examples(index, _as_queries(index))).withColumn("description", F.md5("description"))


@query("r08_many_queries", _ALL_PAIRS_SQL + "5")
def r08(t: Tables) -> DataFrame:
    """Every vector asks, over an index of many small cells."""
    vectors = _vectors(t)
    return _six(R.search(vectors, _as_queries(vectors), k=5, cell_rows=256))


@query("r10_exactness", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS example_id, list_dot_product(q.v, i.v) AS score FROM v q, v i),
hits AS (
  SELECT query_id, example_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, example_id) AS rank FROM pairs)
SELECT query_id, string_agg(example_id, ',' ORDER BY rank) AS hits FROM hits WHERE rank <= 4 GROUP BY 1""")
def r10(t: Tables) -> DataFrame:
    """What cells of 64 rows find, where bounds decide on most visits, is what a scan of everything finds."""
    vectors = _vectors(t)
    ranked = R.search(vectors, _as_queries(vectors), k=4, cell_rows=64).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "example_id"))).alias("hits"))
    return ranked.select("query_id", F.array_join(F.transform("hits", lambda h: h["example_id"].cast("string")), ",").alias("hits"))


@query("r10_approximate_all", _ALL_PAIRS_SQL + "6")
def r10_approximate_all(t: Tables) -> DataFrame:
    """Buckets of random planes of which every query asks for all: the hits of the exact search."""
    vectors = _vectors(t)
    return _six(A.search_approximately(vectors, _as_queries(vectors), k=6, recall=1.0, cell_rows=64))


@query("r10_approximate_recall", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
hits AS (
  SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, i.v), 10) DESC, i.vec_id) AS rank FROM v q, v i)
SELECT count(*) AS wanted, true AS enough FROM hits WHERE rank <= 10""")
def r10_approximate_recall(t: Tables) -> DataFrame:
    """How many of the exact hits there are, and whether the approximate search finds nine of ten."""
    vectors = _vectors(t)
    asked = _as_queries(vectors)
    counted = A.recall_of(A.search_approximately(vectors, asked, k=10, cell_rows=64), R.search(vectors, asked, k=10))
    return counted.select("wanted", (F.col("found") * 10 >= F.col("wanted") * 9).alias("enough"))


# -- generation ------------------------------------------------------------------------------------------

_BLOCKS_SQL = f"""
asked AS (
  SELECT query_id, any_value(asked) AS asked,
    string_agg({quoted(W.request_label)} || description || chr(10) || {quoted(W.code_label)} || chr(10) || code
      || chr(10) || {quoted(W.divider)}, chr(10) ORDER BY rank) AS blocks,
    string_agg(md5(description), ',' ORDER BY rank) AS retrieved,
    string_agg(code, '' ORDER BY rank) FILTER (rank = 1) AS best_code
  FROM hits GROUP BY query_id),
prompts AS (
  SELECT *, {quoted(W.few_shot_intro)} || chr(10) || chr(10) || blocks || chr(10) || chr(10)
    || {quoted(W.few_shot_task)} || chr(10) || chr(10) || {quoted(W.request_label)} || asked
    || chr(10) || chr(10) || {quoted(W.code_label)} AS prompt
  FROM asked)
"""


def _requests(t: Tables) -> DataFrame:
    """One request per indexed example, asking for its own description."""
    return indexed_examples(t).select(
        F.col("example_id").alias("request_id"), "description", "embedding",
        F.lit(G.MAX_TOKENS_DEFAULT).alias("max_tokens"), F.lit(G.TEMPERATURE_DEFAULT).alias("temperature"),
    )


def echo_best(system: str, user: str, temperature: float, max_tokens: int) -> str:
    """Stand-in for a model: answers with the code of the first example, fenced."""
    after = user.split(f"\n{W.code_label}\n", 1)[1]
    return "Answer:\n```python\n" + after.split(f"\n{W.divider}", 1)[0] + "\n```"


def shout_or_fail(system: str, user: str, temperature: float, max_tokens: int) -> str:
    """Stand-in for a model: echoes the request, and fails on requests of an even number of words."""
    words = user.split()
    if len(words) % 2 == 0:
        raise ValueError("even")
    return "```\n" + " ".join(words) + "\n```"


@query("x05_few_shot_prompt", with_hits(
    "SELECT query_id AS request_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM prompts", _BLOCKS_SQL))
def x05(t: Tables) -> DataFrame:
    prompts = G.few_shot_prompts(_requests(t), indexed_examples(t))
    return prompts.select("request_id", F.length("user").alias("n_chars"), F.md5("user").alias("digest"))


@query("p05_responses", with_hits("""
SELECT query_id AS request_id, md5(asked) AS description, best_code AS code, 'echo' AS model, 'rag' AS approach,
  retrieved FROM prompts""", _BLOCKS_SQL))
def p05(t: Tables) -> DataFrame:
    return _responses(G.generate_with_retrieval(_requests(t), indexed_examples(t), echo_best, "echo"))


def _responses(responses: DataFrame) -> DataFrame:
    retrieved = F.array_join(F.transform("retrieved_examples", lambda d: F.md5(d)), ",")
    return responses.select(
        "request_id", F.md5("description").alias("description"), "code", "model", "approach",
        retrieved.alias("retrieved"),
    )


@query("u01_embedding_function", f"""
SELECT conv_id * 4294967296 + turn AS example_id, coalesce(n_words, 0) AS n_words, coalesce(n_buckets, 0) AS n_buckets
FROM conversations LEFT JOIN (SELECT example_id, sum(n) AS n_words, count(*) AS n_buckets FROM (
  SELECT example_id, {_MD5_BUCKET} AS bucket, count(*) AS n FROM (
    SELECT example_id, unnest({sql_tokens('description')}) AS w FROM (
      SELECT conv_id * 4294967296 + turn AS example_id, text AS description FROM conversations))
  GROUP BY ALL) GROUP BY 1) ON example_id = conv_id * 4294967296 + turn""")
def u01(t: Tables) -> DataFrame:
    """A user-supplied embedding model on every conversation turn."""
    texts = t.conversations.select((F.col("conv_id") * 2**32 + F.col("turn")).alias("example_id"), "text")
    vectors = G.embed(texts, "text", G.hashed_words(64))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors.select(
        "example_id", total.cast("bigint").alias("n_words"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("n_buckets"),
    )


_TURNS_SQL = f"""
turns AS (
  SELECT conv_id * 4294967296 + turn AS request_id, text, {sql_tokens('text')} AS w FROM conversations)
"""


def _turn_prompts(t: Tables) -> DataFrame:
    return t.conversations.select(
        (F.col("conv_id") * 2**32 + F.col("turn")).alias("request_id"), F.col("text").alias("description"),
        F.lit(G.MAX_TOKENS_DEFAULT).alias("max_tokens"), F.lit(G.TEMPERATURE_DEFAULT).alias("temperature"),
    )


@query("u02_completion_function", f"""
WITH {_TURNS_SQL}
SELECT request_id, CASE WHEN len(w) % 2 = 1 THEN '```' || chr(10) || array_to_string(w, ' ') || chr(10) || '```' END
  AS text, CASE WHEN len(w) % 2 = 0 THEN 'ValueError: even' END AS error FROM turns""")
def u02(t: Tables) -> DataFrame:
    prompts = G.zero_shot_prompts(_turn_prompts(t)).drop("description")
    return G.complete(prompts, shout_or_fail).select("request_id", "text", "error")


@query("d07_batch_predictions", with_hits("""
SELECT query_id AS example_id, 'rag' AS approach, best_code AS code, NULL::VARCHAR AS error FROM prompts""", _BLOCKS_SQL))
def d07(t: Tables) -> DataFrame:
    index = indexed_examples(t)
    return G.predict(index.drop("code"), index, echo_best)


@query("d08_failure_isolation", f"""
WITH {_TURNS_SQL}
SELECT request_id, CASE WHEN len(w) % 2 = 1 THEN array_to_string(w, ' ') ELSE '' END AS code, len(w) % 2 = 0 AS failed
FROM turns""")
def d08(t: Tables) -> DataFrame:
    responses = G.generate_zero_shot(_turn_prompts(t), shout_or_fail, "echo")
    return responses.select("request_id", "code", F.col("error").isNotNull().alias("failed"))


@query("d09_generate_with_retrieval", with_hits("""
SELECT query_id AS request_id, md5(asked) AS description, best_code AS code, 'echo' AS model, 'rag' AS approach,
  retrieved FROM prompts""", _BLOCKS_SQL))
def d09(t: Tables) -> DataFrame:
    """The whole flow on a stored index: search, prompt, complete, extract, respond."""
    return _responses(G.generate_with_retrieval(_requests(t), _stored_index(t), echo_best, "echo"))


@query("d10_generate_zero_shot", f"""
WITH {_TURNS_SQL}
SELECT request_id, md5(text) AS description, CASE WHEN len(w) % 2 = 1 THEN array_to_string(w, ' ') ELSE '' END AS code,
  'echo' AS model, 'finetune' AS approach, '' AS retrieved FROM turns""")
def d10(t: Tables) -> DataFrame:
    return _responses(G.generate_zero_shot(_turn_prompts(t), shout_or_fail, "echo"))


@query("d14_syntax_check", """
SELECT approach, count(*) AS n, count(*) FILTER (ok) AS n_ok, (count(*) FILTER (ok))::DOUBLE / count(*) AS ok_share
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'rag' ELSE 'finetune' END AS approach, doc_id % 3 > 0 AS ok FROM documents)
GROUP BY 1""")
def d14(t: Tables) -> DataFrame:
    """A call for each document; every third has its closing bracket missing."""
    call = F.concat(F.lit('df = spark.table("'), "source", F.lit('").limit('), "n_chars")
    code = F.when(F.col("doc_id") % 3 == 0, call).otherwise(F.concat(call, F.lit(")")))
    approach = F.when(F.col("doc_id") % 2 == 0, "rag").otherwise("finetune")
    return G.syntax_share(t.documents.select(approach.alias("approach"), code.alias("code")))


# -- streams ------------------------------------------------------------------------------------------------


@query("t01_request_stream", f"WITH {CHECKED_REQUESTS_SQL} SELECT * FROM judged")
def t01(t: Tables) -> DataFrame:
    """All events as a stream of requests, checked on arrival."""
    path = f"{t.folder}/events.parquet"
    events = read_request_stream(t.spark, f"{path}*", t.events.schema)
    out = scratch_path(t.spark, "checked")
    validate_stream(event_requests(events), out, scratch_path(t.spark, "progress")).awaitTermination()
    return t.spark.read.parquet(out)


@query("t02_prompt_stream", f"""
WITH {INDEXED_SQL},
asking AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
pairs AS (
  SELECT vec_id AS query_id, 'request ' || label AS asked, i.example_id, i.description, i.code,
    list_dot_product(q.v, i.v) AS score FROM asking q, indexed i),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, example_id) AS rank
  FROM pairs QUALIFY rank <= 3),
{_BLOCKS_SQL}
SELECT query_id AS request_id, md5(prompt) AS digest, retrieved FROM prompts""")
def t02(t: Tables) -> DataFrame:
    """All vectors as a stream of requests; each micro-batch is searched and turned into prompts."""
    vectors = read_request_stream(t.spark, f"{t.folder}/embeddings.parquet*", t.embeddings.schema)
    index = indexed_examples(t)
    requests = vectors.select(
        F.col("vec_id").alias("request_id"), F.concat(F.lit("request "), F.col("label").cast("string")).alias("description"),
        "embedding", F.lit(None).cast("int").alias("max_tokens"), F.lit(None).cast("double").alias("temperature"),
    )
    out = scratch_path(t.spark, "prompts")
    prompt_stream(requests, index, out, scratch_path(t.spark, "progress")).awaitTermination()
    retrieved = F.array_join(F.transform("retrieved_examples", lambda d: F.md5(d)), ",")
    return t.spark.read.parquet(out).select(
        "request_id", F.md5("user").alias("digest"), retrieved.alias("retrieved")
    )
