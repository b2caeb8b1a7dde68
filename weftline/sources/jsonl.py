"""JSON-lines files: numbered scans, prediction and chat datasets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.prompts import DEFAULT_WORDING, Wording, chat_messages
from weftline.functions.text import strip
from weftline.operators.positions import dense_ordinal, positional_split
from weftline.session import stored

CHAT_SCHEMA = "messages array<struct<role:string,content:string>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the file(s) as (path, line_num, value), numbered from 1 per file.

    Blank lines count. A missing path raises FileNotFoundError before anything runs.

    A task numbers the lines of the input splits it reads by itself; what a line needs on
    top is how many lines its file has in earlier splits. That is one small row per split,
    found by a scan of the same splits that keeps no text. The wide lines are not shuffled.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from exc
        raise
    split = ["_path_hash", "_start", "_length", "_task"]
    rows = raw.select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.xxhash64("_metadata.file_path").alias("_path_hash"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"),
        F.spark_partition_id().alias("_task"),
        F.monotonically_increasing_id().alias("_row"),
    )
    per_split = rows.groupBy(*split, "path").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_split.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        *split, (F.col("_earlier") - F.col("_first") + 1).alias("_shift")
    )
    # Bounded: one row of five numbers per input split, and the driver lists the splits anyway.
    # Without a match the two scans saw different splits; stop rather than number wrongly.
    shifted = F.coalesce("_shift", F.raise_error(F.lit("input splits changed during the scan; run again")))
    return rows.join(F.broadcast(shift), split, "left").select(
        "path", (F.col("_row") + shifted.cast("bigint")).alias("line_num"), "value"
    )


def non_blank(lines: DataFrame) -> DataFrame:
    """Stripped, non-empty lines; their line numbers stay as they were."""
    return lines.withColumn("value", strip("value")).filter(F.col("value") != "")


def read_predictions(spark: SparkSession, path: str, code_field: str = "pyspark_code", mode: str = "failfast") -> DataFrame:
    """Predictions as (ordinal, code): ordinal is the 0-based place among the non-blank lines.

    Several files count as one, in path order. A line that is no JSON object, or has no string in ``code_field``, is a bad line. It stops the job, which
    names it ('failfast'), or its row has a null code and ``error`` says what is wrong ('flag').
    """
    lines = dense_ordinal(non_blank(read_lines(spark, path)), "line_num", within=["path"])
    # Read as a variant: a plain string column would turn numbers into text, and tell neither absent from null nor broken lines from both.
    # The line goes before its own hash in a list, since the parser ignores what follows the first value.
    seal = F.xxhash64("value").cast("string")
    parsed = lines.withColumn("_list", F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit(',"'), seal, F.lit('"]'))))
    at = lambda place, kind: F.try_variant_get("_list", place, kind)
    whole = (at("$[1]", "string") == seal) & at("$[2]", "variant").isNull() & F.schema_of_variant(at("$[0]", "variant")).startswith("OBJECT")
    field = f"$[0]['{code_field}']"
    kind = F.schema_of_variant(at(field, "variant"))
    error = (
        F.when(~F.coalesce(whole, F.lit(False)), "not a JSON object")
        .when(kind.isNull(), f"{code_field}: missing").when(kind != "STRING", f"{code_field}: not a string"))
    read = parsed.select("path", "line_num", "ordinal", at(field, "string").alias("code"), error.alias("error"))
    if mode == "flag":
        return read.select("ordinal", F.when(F.col("error").isNull(), F.col("code")).alias("code"), "error")
    if mode != "failfast":
        raise ValueError(f"unknown mode {mode!r}")
    stop = F.raise_error(F.concat(F.col("path"), F.lit(", line "), F.col("line_num").cast("string"), F.lit(": "), F.col("error")))
    return read.select("ordinal", F.when(F.col("error").isNull(), F.col("code")).otherwise(stop.cast("string")).alias("code"))


def write_predictions(
    predictions: DataFrame, path: str, key: str = "example_id", code_field: str = "pyspark_code"
) -> None:
    """One JSON object per prediction, sorted by key over the part files, failures as empty code.

    The predictions are stored before they are sorted: a global sort samples its input first,
    and the model behind them must not be asked twice.
    """
    rows = stored(predictions.select(key, F.coalesce("code", F.lit("")).alias(code_field)), "predictions")
    rows.orderBy(key).write.mode("errorifexists").json(path)


def write_chat_dataset(
    examples: DataFrame,
    path: str,
    position: str = "line_num",
    within: tuple[str, ...] = (),
    val_split: float = 0.1,
    wording: Wording = DEFAULT_WORDING,
) -> None:
    """Split by position and write chat conversations below split=train and split=val."""
    (
        positional_split(examples, position, val_split, within)
        .select("split", chat_messages("description", "code", wording).alias("messages"))
        .write.partitionBy("split").mode("errorifexists").json(path)
    )


def read_chat_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The conversations with their split; the schema is given, so nothing is inferred."""
    return spark.read.schema(f"{CHAT_SCHEMA}, split string").json(path)
