"""Streams of request rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.functions.prompts import DEFAULT_WORDING, Wording
from weftline.operators.generate import check_requests, few_shot_prompts


def read_request_stream(
    spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000
) -> DataFrame:
    """New Parquet files of a folder (or glob) as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def validate_stream(requests: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Check requests as they arrive; stateless. Writes all of them, rejected ones with a problem."""
    return _start(check_requests(requests).writeStream.format("parquet").option("path", out), checkpoint, available_now)


def prompt_stream(
    requests: DataFrame,
    index: DataFrame,
    out: str,
    checkpoint: str,
    k: int | None = None,
    embed_fn: Callable[[DataFrame], DataFrame] | None = None,
    wording: Wording = DEFAULT_WORDING,
    available_now: bool = True,
) -> StreamingQuery:
    """Valid requests to prompts, batch by batch.

    Ranking windows do not run on streams, so each micro-batch is searched as a batch. A batch
    is written below its own ``batch_id`` folder with overwrite: a batch that is run again
    after a failure replaces its first output instead of adding to it.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        valid = check_requests(batch).filter(F.col("problem").isNull()).drop("problem")
        # The search looks at the requests more than once; keep their embeddings meanwhile.
        asked = (embed_fn(valid) if embed_fn else valid).persist()
        try:
            few_shot_prompts(asked, index, k, wording).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            asked.unpersist()

    return _start(requests.writeStream.foreachBatch(each), checkpoint, available_now)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
