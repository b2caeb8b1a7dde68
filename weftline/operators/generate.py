"""Requests to code: validation, embedding and completion functions, batch generation."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType

from weftline.functions.prompts import DEFAULT_WORDING, Wording, few_shot_prompt
from weftline.functions.text import _col, extract_code
from weftline.functions.vectors import bucket_weights, weighted_counts
from weftline.operators.retrieval import l2_normalize, search_examples, vector_length, vector_problem
from weftline.session import stored

# Defaults and accepted ranges of a request.
MAX_TOKENS_DEFAULT, MAX_TOKENS_RANGE = 2048, (64, 4096)
TEMPERATURE_DEFAULT, TEMPERATURE_RANGE = 0.1, (0.0, 2.0)
# Bytes of prompts that a task has as Python strings at a time.
PART_BYTES = 1 << 22

Complete = Callable[[str, str, float, int], str]


# -- requests -----------------------------------------------------------------------------------


def or_default(value: Column | str, default: object) -> Column:
    """Null and 0 both mean the default (as for ``k`` and ``max_tokens`` arguments)."""
    return F.coalesce(F.nullif(_col(value), F.lit(0)), F.lit(default))


def check_requests(requests: DataFrame) -> DataFrame:
    """Fill absent parameters and add ``problem``: null for requests that may run.

    Works on batch and streaming DataFrames alike.
    """
    low, high = MAX_TOKENS_RANGE
    cold, hot = TEMPERATURE_RANGE
    filled = requests.withColumn(
        "max_tokens", F.coalesce("max_tokens", F.lit(MAX_TOKENS_DEFAULT))
    ).withColumn("temperature", F.coalesce("temperature", F.lit(TEMPERATURE_DEFAULT)))
    problem = F.concat_ws(
        "; ",
        F.when(F.col("description").isNull(), F.lit("description: missing")),
        F.when(~F.col("max_tokens").between(low, high), F.lit(f"max_tokens: not in {low}..{high}")),
        F.when(~F.col("temperature").between(cold, hot), F.lit(f"temperature: not in {cold}..{hot}")),
    )
    return filled.withColumn("problem", F.nullif(problem, F.lit("")))


# -- opaque functions ------------------------------------------------------------------------------


def hashed_words(dim: int = 64) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Model-free embedding: counts of words hashed into ``dim`` buckets."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        @lru_cache(maxsize=1 << 18)
        def bucket(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim

        def embed_texts(texts: np.ndarray) -> np.ndarray:
            counts = [np.bincount([bucket(w) for w in text.split()] or [0], minlength=dim) for text in texts]
            empty = [i for i, text in enumerate(texts) if not text.strip()]
            out = np.array(counts, np.float32)
            out[empty] = 0
            return out

        return embed_texts

    return make


def embed(
    df: DataFrame,
    text: str = "description",
    make_model: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None,
    batch_size: int = 256,
    out: str = "embedding",
) -> DataFrame:
    """Add an embedding of ``text``. ``make_model`` loads a model once per Python worker.

    A null text has a null vector, which ``rejected_queries`` and ``rejected_examples`` name and ``build_index`` stops on; the model sees an empty text in its place.
    """
    model = predict_batch_udf(
        make_model or hashed_words(), return_type=ArrayType(FloatType()), batch_size=batch_size
    )
    return df.withColumn(out, F.when(_col(text).isNotNull(), model(F.coalesce(_col(text), F.lit("")))))


def embed_weighted(df: DataFrame, text: str = "description", dim: int = 64, out: str = "embedding") -> DataFrame:
    """Add unit vectors of hashed word counts, in which words of buckets that few texts use weigh more: an embedding that needs no model.

    The counts are made once and stored; a pass over them gives the weights, and the vectors are column expressions. Null texts have null vectors and count for nothing.
    """
    counted = stored(embed(df, text, hashed_words(dim), out="_counts"), "word-counts")
    weights = bucket_weights(counted, "_counts", dim)
    unit = l2_normalize(weighted_counts("_counts", weights))
    return counted.withColumn(out, F.when(F.col("_counts").isNotNull(), unit)).drop("_counts")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PART_BYTES``, or of one row."""
    step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
    for begin in range(0, batch.num_rows, step):
        yield batch.slice(begin, step)


def complete(prompts: DataFrame, fn: Complete, per_task: Callable[[], Complete] | None = None) -> DataFrame:
    """Run ``fn(system, user, temperature, max_tokens)`` on each prompt row.

    Adds ``text`` and ``error``. A failing row gets its error message and no text; the job
    goes on. A row whose ``rejected`` column gives a reason is not run, and has that as its error. ``per_task`` makes the function once per task instead (say, to open a client).
    """
    columns = prompts.columns
    used = [c for c in ("system", "user", "temperature", "max_tokens", "rejected") if c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = per_task() if per_task else fn
        # A batch has thousands of rows; only a few texts at a time become Python strings.
        for part in (part for batch in batches for part in _parts(batch)):
            texts: list[str | None] = []
            errors: list[str | None] = []
            asked = pa.Table.from_batches([part.select(used)]).to_pandas()
            reasons = asked["rejected"] if "rejected" in columns else [None] * len(asked)
            for system, user, temperature, max_tokens, reason in zip(
                asked["system"], asked["user"], asked["temperature"], asked["max_tokens"], reasons
            ):
                if reason is not None:
                    texts.append(None)
                    errors.append(f"rejected: {reason}")
                    continue
                try:
                    texts.append(call(system, user, float(temperature), int(max_tokens)))
                    errors.append(None)
                except Exception as exc:
                    texts.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*part.schema.names, "text", "error"])

    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", text string, error string"
    return prompts.mapInArrow(run, schema).select(*columns, "text", "error")


@F.pandas_udf(BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Is the text valid Python syntax? It is parsed, never run."""

    def ok(text: str | None) -> bool:
        try:
            ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.map(ok)


def syntax_share(results: DataFrame, by: str = "approach") -> DataFrame:
    """Share of results with valid syntax per approach."""
    return (
        results.select(by, parses("code").alias("syntax_ok"))
        .groupBy(by)
        .agg(F.count("*").alias("n"), F.count_if("syntax_ok").alias("n_ok"))
        .withColumn("ok_share", F.col("n_ok") / F.col("n"))
    )


# -- generation flows ----------------------------------------------------------------------------------


def zero_shot_prompts(requests: DataFrame, wording: Wording = DEFAULT_WORDING) -> DataFrame:
    """System and user text without examples."""
    return requests.withColumn("system", F.lit(wording.system)).withColumn("user", F.col("description"))


def few_shot_prompts(
    requests: DataFrame, index: DataFrame, k: int | None = None, wording: Wording = DEFAULT_WORDING
) -> DataFrame:
    """Search the index for each request and build its prompt.

    Adds ``system``, ``user``, ``retrieved_examples`` (hit descriptions in rank order) and ``rejected``: why a request's vector could not be searched, or null.
    A rejected request has no prompt, so that it is not taken for one without hits.
    Requests need (request_id, description, embedding) and are read more than once, so the
    embedding should be a stored column. At most k hits per request are gathered into a list.
    """
    asked = requests.select(F.col("request_id").alias("query_id"), "embedding")
    hits = search_examples(index, asked, k)
    length = vector_length(index)
    ranked = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "description", "code"))).alias("hits")
    )
    no_hits = F.array().cast("array<struct<rank:int,description:string,code:string>>")
    return (
        requests.withColumn("rejected", vector_problem("embedding", length))
        .drop("embedding")
        .join(ranked, F.col("request_id") == F.col("query_id"), "left")
        .drop("query_id")
        .withColumn("hits", F.coalesce("hits", no_hits))
        .withColumn("system", F.lit(wording.system))
        .withColumn("user", F.when(F.col("rejected").isNull(), few_shot_prompt("description", "hits", wording)))
        .withColumn("retrieved_examples", F.col("hits.description"))
        .drop("hits")
    )


def respond(completed: DataFrame, model: str, approach: str, id_column: str = "request_id") -> DataFrame:
    """Response rows; code is extracted from the text, and empty where the call failed."""
    retrieved = (
        F.col("retrieved_examples")
        if "retrieved_examples" in completed.columns
        else F.array().cast("array<string>")
    )
    return completed.select(
        id_column,
        "description",
        F.coalesce(extract_code("text"), F.lit("")).alias("code"),
        F.lit(model).alias("model"),
        F.lit(approach).alias("approach"),
        retrieved.alias("retrieved_examples"),
        "error",
    )


def generate_with_retrieval(
    requests: DataFrame, index: DataFrame, fn: Complete, model: str, k: int | None = None,
    wording: Wording = DEFAULT_WORDING,
) -> DataFrame:
    """Search, prompt, complete, extract, respond (approach 'rag')."""
    return respond(complete(few_shot_prompts(requests, index, k, wording), fn), model, "rag")


def generate_zero_shot(
    requests: DataFrame, fn: Complete, model: str, wording: Wording = DEFAULT_WORDING
) -> DataFrame:
    """Prompt, complete, extract, respond (approach 'finetune')."""
    return respond(complete(zero_shot_prompts(requests, wording), fn), model, "finetune")


def predict(
    examples: DataFrame, index: DataFrame, fn: Complete, k: int | None = None, wording: Wording = DEFAULT_WORDING
) -> DataFrame:
    """Batch predictions (example_id, approach, code, error) for an evaluation set with embeddings."""
    requests = examples.select(
        F.col("example_id").alias("request_id"), "description", "embedding",
        F.lit(MAX_TOKENS_DEFAULT).alias("max_tokens"), F.lit(TEMPERATURE_DEFAULT).alias("temperature"),
    )
    return generate_with_retrieval(requests, index, fn, "", k, wording).select(
        F.col("request_id").alias("example_id"), "approach", "code", "error"
    )
