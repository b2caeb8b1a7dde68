"""Corpus statistics and data quality of example sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.metrics import operations_in
from weftline.functions.prompts import DEFAULT_WORDING, Wording, chatml_text
from weftline.functions.text import tokens

# Memory tier in GB and the longest sequence (tokens) trained on it.
SEQUENCE_TIERS = ((80, 2048), (40, 2048), (24, 2048), (16, 1536), (0, 1024))


def set_sizes(**sets: DataFrame) -> DataFrame:
    """Row count of each named set."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("set_name"), "n") for name, df in sets.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.union(other)
    return out


def complexity_histogram(examples: DataFrame, position: str = "line_num") -> DataFrame:
    """Examples per complexity, most common first; ties by first appearance."""
    return (
        examples.groupBy("complexity")
        .agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
        .orderBy(F.desc("n"), "first_seen")
    )


def top_operations(examples: DataFrame, position: str = "line_num", n: int = 10) -> DataFrame:
    """Most used declared operations; ties by first appearance in the corpus."""
    return (
        examples.select(position, F.posexplode("operations").alias("pos", "operation"))
        .groupBy("operation")
        .agg(F.count("*").alias("n"), F.min(F.struct(position, "pos")).alias("first_seen"))
        .orderBy(F.desc("n"), "first_seen")
        .limit(n)
        .select("operation", "n")
    )


def referenced_tables(examples: DataFrame) -> DataFrame:
    """Distinct referenced tables, sorted."""
    return examples.select(F.explode("tables").alias("table_name")).distinct().orderBy("table_name")


def count_referenced_tables(examples: DataFrame) -> DataFrame:
    return examples.select(F.explode("tables").alias("table_name")).agg(
        F.count_distinct("table_name").alias("n_tables")
    )


def unknown_tables(examples: DataFrame, catalog: DataFrame, code: str = "code") -> DataFrame:
    """Table names read by the code that the catalog (table_name) does not have, with use counts.

    Names are counted before the anti join, so a much used name is one row there.
    """
    name = F.regexp_extract_all(F.col(code), F.lit(r"""spark\.table\(["']([^"']+)["']\)"""), 1)
    used = examples.select(F.explode(name).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("uses"))
    return used.join(catalog.select("table_name").distinct(), "table_name", "left_anti")


def request_outcomes(
    log: DataFrame, period: Column, accepted_above: float = 0.6
) -> DataFrame:
    """Acceptance rate and mean seconds from request to delivery by period.

    ``log`` has requested_at, delivered_at (null while open) and accepted.
    """
    lead = F.unix_micros(F.col("delivered_at").cast("timestamp")) - F.unix_micros(
        F.col("requested_at").cast("timestamp")
    )
    return (
        log.groupBy(period.alias("period"))
        .agg(
            F.count("*").alias("requests"),
            (F.count_if("accepted") / F.count("*")).alias("acceptance_rate"),
            # Microseconds of many requests add up to more than a long holds.
            (F.sum(lead.cast("decimal(19,0)")).cast("double") / F.count(lead) / 1e6).alias("mean_lead_seconds"),
        )
        .withColumn("on_target", F.col("acceptance_rate") > accepted_above)
    )


def sequence_budget(
    examples: DataFrame,
    tiers: Sequence[tuple[int, int]] = SEQUENCE_TIERS,
    wording: Wording = DEFAULT_WORDING,
) -> DataFrame:
    """Share of examples whose training text exceeds each tier's longest sequence.

    The unit is whitespace tokens of the chat text (no model tokenizer is involved). Lengths
    are counted first; the tiers then meet one row per distinct length.
    """
    lengths = (
        examples.select(F.size(tokens(chatml_text("description", "code", wording))).alias("length"))
        .groupBy("length")
        .agg(F.count("*").alias("n"))
    )
    budgets = [F.struct(F.lit(m).alias("memory_gb"), F.lit(s).alias("max_tokens")) for m, s in tiers]
    over = F.coalesce(F.sum(F.when(F.col("length") > F.col("max_tokens"), F.col("n"))), F.lit(0))
    return (
        lengths.select("length", "n", F.inline(F.array(*budgets)))
        .groupBy("memory_gb", "max_tokens")
        .agg(F.sum("n").alias("examples"), over.alias("over_budget"))
        .withColumn("over_share", F.col("over_budget") / F.col("examples"))
    )


def label_check(examples: DataFrame, key: str = "example_id") -> DataFrame:
    """Declared operations against those found in the code: what is missing on either side."""
    found, declared = operations_in("code"), F.array_distinct("operations")
    return examples.select(
        key,
        "complexity",
        F.array_sort(F.array_except(found, declared)).alias("undeclared"),
        F.array_sort(F.array_except(declared, found)).alias("not_in_code"),
    )


def label_summary(checked: DataFrame) -> DataFrame:
    """Examples per complexity, and how many have labels that disagree with the code."""
    return checked.groupBy("complexity").agg(
        F.count("*").alias("examples"),
        F.count_if(F.size("undeclared") > 0).alias("with_undeclared"),
        F.count_if(F.size("not_in_code") > 0).alias("with_not_in_code"),
    )
