"""Scoring predictions against references: per example, in aggregate, and between approaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.functions.text import fixed4, preview
from weftline.operators.ngrams import token_scores
from weftline.operators.positions import dense_ordinal

# The four reported metrics, in report order.
METRICS = ("bleu", "exact_match", "operation_coverage", "structural_similarity")


def pair_by_id(
    examples: DataFrame, predictions: DataFrame, key: str = "example_id", on_mismatch: str = "error"
) -> DataFrame:
    """Examples with their prediction as ``candidate``.

    Ids found on one side only, or more than once on a side, stop the job ('error') or stay as rows whose ``unmatched`` column says
    "example", "prediction", "repeated example" or "repeated prediction" ('flag'). A null id has no partner. Of repeated predictions one row comes out for each
    example of the id, with the least code as candidate.

    Both sides are counted by id before they meet, so a repeated id is one row there, and the texts are shuffled by id alone.
    """
    if on_mismatch not in ("error", "flag"):
        raise ValueError(f"unknown on_mismatch {on_mismatch!r}")
    one = predictions.groupBy(key).agg(F.min("code").alias("candidate"), F.count("*").alias("_predictions"))
    times = examples.groupBy(key).agg(F.count("*").alias("_examples"))
    known = times.join(one, key, "full").withColumn("unmatched", (
        F.when(F.col("_predictions").isNull(), "example").when(F.col("_examples").isNull(), "prediction")
        .when(F.col("_predictions") > 1, "repeated prediction").when(F.col("_examples") > 1, "repeated example")))
    # Examples with a null id meet nothing, not even their own count.
    known = known.filter(F.col(key).isNotNull() | F.col("_predictions").isNotNull()).select(key, "candidate", "unmatched")
    joined = examples.join(known, key, "full").withColumn(
        "unmatched", F.when(F.col(key).isNull(), F.coalesce("unmatched", F.lit("example"))).otherwise(F.col("unmatched")))
    if on_mismatch == "flag":
        return joined
    what = F.when(F.col("unmatched").isin("example", "prediction"), F.concat(F.lit("no partner for "), F.col("unmatched"))).otherwise(F.col("unmatched"))
    message = F.concat(what, F.lit(" "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.col("unmatched").isNull(), F.col("candidate")).otherwise(F.raise_error(message).cast("string"))
    return joined.withColumn("candidate", checked).drop("unmatched")


def pair_by_position(
    examples: DataFrame, predictions: DataFrame, position: str = "line_num", within: Sequence[str] = ("path",)
) -> DataFrame:
    """Pair the n-th example with the n-th prediction, both counted without blank lines."""
    return pair_by_id(dense_ordinal(examples, position, within=within), predictions, key="ordinal")


def self_baseline(examples: DataFrame, reference: str = "code") -> DataFrame:
    """Every example predicting itself: what a perfect approach scores."""
    return examples.withColumn("candidate", F.col(reference))


def row_scores(
    pairs: DataFrame, keep: Sequence[str], reference: str = "code", candidate: str = "candidate"
) -> DataFrame:
    """The scores that need no n-grams, computed row by row."""
    return (
        pairs.withColumn("_ref", M.patterns_in(reference))
        .withColumn("_cand", M.patterns_in(candidate))
        .select(
            *keep,
            M.exact_match(reference, candidate).alias("exact_match"),
            M.operation_coverage(reference, candidate).alias("operation_coverage"),
            M.jaccard(F.col("_ref"), F.col("_cand")).alias("structural_similarity"),
        )
    )


def evaluate(
    pairs: DataFrame,
    key: str = "example_id",
    keep: Sequence[str] = ("description",),
    reference: str = "code",
    candidate: str = "candidate",
    epsilon: float = 0.1,
) -> DataFrame:
    """One row per pair with all scores, plus the columns to ``keep``: a projection, which reads ``pairs`` once.

    A null candidate scores like an empty one.
    """
    texts = pairs.withColumn(candidate, F.coalesce(candidate, F.lit("")))
    scores = ["exact_match", "operation_coverage", "structural_similarity"]
    by_row = row_scores(texts, [*dict.fromkeys([key, *keep, reference, candidate])], reference, candidate)
    return token_scores(by_row, [*dict.fromkeys([key, *keep, *scores])], reference, candidate, epsilon).select(
        key, *keep, "bleu", "unigram_precision", "exact_match", "operation_coverage", "structural_similarity"
    )


def _as_number(metric: str) -> Column:
    return F.col(metric).cast("double")


def aggregate(results: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric (exact matches count 1); a missing score counts 0, and zeros come when there are no rows."""
    means = [F.coalesce(F.avg(F.coalesce(_as_number(m), F.lit(0.0))), F.lit(0.0)).alias(m) for m in metrics]
    return results.groupBy(*by).agg(*means)


def long_form(aggregated: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric: (*by, metric, score)."""
    return aggregated.unpivot([F.col(c) for c in by], [F.col(m) for m in metrics], "metric", "score")


def report(results: DataFrame, key: str = "example_id") -> DataFrame:
    """Report rows (part, place, subject, measure, score): the mean of each measure, then those of every example, numbered from 1 by ``key``.

    Scores are texts of four decimals, and the subject is the beginning of the description. ``results`` is read several times; pass a stored table rather than
    a running evaluation.
    """
    written = lambda rows, part, subject, by: rows.select(
        F.lit(part).alias("part"), by.cast("bigint").alias("place"), subject.alias("subject"), F.col("metric").alias("measure"), fixed4("score").alias("score"))
    means = written(long_form(aggregate(results)), "means", F.lit("all examples"), F.lit(0))
    scored = dense_ordinal(results.select(key, "description", *[_as_number(m).alias(m) for m in METRICS]), key)
    each = written(long_form(scored, ["ordinal", "description"]), "examples", preview("description", 60), F.col("ordinal") + 1)
    return means.union(each)


def compare_approaches(results: DataFrame, first: str, second: str, by: str = "approach") -> DataFrame:
    """Per metric the mean of two approaches on the same examples, and the difference."""
    means = long_form(aggregate(results, [by]), [by])
    return (
        means.groupBy("metric")
        .pivot(by, [first, second])
        .agg(F.first("score"))
        .withColumn("delta", F.col(f"`{second}`") - F.col(f"`{first}`"))
    )


def quality_gate(aggregated: DataFrame, metric: str = "operation_coverage", above: float = 0.85) -> DataFrame:
    """Add ``passed``: is the mean above the target?"""
    return aggregated.withColumn("passed", F.col(metric) > F.lit(above))


def promotion_check(
    current: DataFrame, challenger: DataFrame, metric: str = "operation_coverage"
) -> DataFrame:
    """Compare two one-row aggregates: promote only when the challenger is better."""
    scores = current.select(
        F.col(metric).alias("current_score"), challenger.select(metric).scalar().alias("challenger_score")
    )
    return scores.withColumn("promote", F.col("challenger_score") > F.col("current_score"))
