"""Strict record validation with a quarantine for bad lines.

``from_json`` with plain STRING columns would turn numbers into text and could not tell an
absent field from a null one, so fields are parsed as VARIANT and their types checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import _col
from weftline.session import stored
from weftline.sources.jsonl import non_blank, read_lines

DEFAULT_COMPLEXITY = "medium"


class ValidationError(ValueError):
    """Raised in failfast mode; ``quarantine`` is the full DataFrame of bad lines."""

    def __init__(self, message: str, quarantine: DataFrame) -> None:
        super().__init__(message)
        self.quarantine = quarantine


def _parse_objects(lines: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``_o``, the line as a struct of VARIANTs, NULL unless the line is exactly one JSON object.

    Spark's parser ignores text after the first JSON value. So the line goes between ``[`` and
    a closing element that carries the line's own hash: trailing text breaks the array.
    """
    text, seal = F.col("value"), F.xxhash64("value").cast("string")
    wrapped = F.concat(F.lit("["), text, F.lit(',{"_seal":"'), seal, F.lit('"}]'))
    struct = ", ".join([f"`{f}`: variant" for f in fields] + ["_seal: string"])
    parsed = F.from_json(wrapped, f"array<struct<{struct}>>", {"allowSingleQuotes": "false"})
    whole = text.startswith("{") & (F.size("_parsed") == 2) & (F.get("_parsed", F.lit(1))["_seal"] == seal)
    return lines.withColumn("_parsed", parsed).withColumn("_o", F.when(whole, F.get("_parsed", F.lit(0))))


def _named(field: str) -> Column:
    """Does the object have the key after all? A value that repeats a key inside itself makes no variant, and would pass for an absent field.

    Only lines that can spell the key are looked at again.
    """
    spelled = F.contains("value", F.lit(f'"{field}"')) | F.contains("value", F.lit("\\u"))
    return F.col("_o").isNotNull() & spelled & F.array_contains(F.json_object_keys("value"), field)


def check_examples(lines: DataFrame, code_field: str = "pyspark_code") -> DataFrame:
    """Parse (path, line_num, value) lines; every non-blank line comes back.

    ``kind`` is null for good lines, 'json' for lines that are no JSON object and 'schema'
    for objects that break the record's rules; ``detail`` says which. A field whose value repeats a key inside itself breaks them (where that is
    deeper than the value's own keys, the parser gives the whole line up); of a field that is repeated, the last one counts. Parsing, field types and
    messages are separate steps, so that no expensive expression is written out twice.
    """
    required, lists = {"description": "description", "code": code_field}, ["tables", "operations"]
    fields = [*required.values(), *lists, "complexity"]
    parsed = _parse_objects(non_blank(lines), fields)
    typed = parsed.select(
        "path",
        "line_num",
        F.col("value").alias("raw"),
        F.col("_o").isNull().alias("_broken"),
        *[F.coalesce(F.schema_of_variant(F.col("_o")[f]), F.when(_named(f), F.lit("BROKEN"))).alias(f"_is_{f}") for f in fields],
        *[F.try_variant_get(F.col("_o")[f], "$", "string").alias(name) for name, f in required.items()],
        *[F.try_variant_get(F.col("_o")[f], "$", "array<string>").alias(f) for f in lists],
        F.try_variant_get(F.col("_o")["complexity"], "$", "string").alias("complexity"),
    )

    problems = []
    for field in required.values():
        kind = F.col(f"_is_{field}")
        problems += [
            F.when(kind.isNull(), F.lit(f"{field}: missing")),
            F.when(kind != "STRING", F.lit(f"{field}: not a string")),
        ]
    for field in lists:
        kind = F.col(f"_is_{field}")
        good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(field, lambda x: x.isNull())
        problems.append(F.when(kind.isNotNull() & ~good, F.lit(f"{field}: not a list of strings")))
    problems.append(F.when(F.col("_is_complexity") != "STRING", F.lit("complexity: not a string")))

    broken, found = F.col("_broken"), F.col("_problems")
    row = F.struct(
        "path",
        "line_num",
        F.when(broken, "json").when(found != "", "schema").alias("kind"),
        F.when(broken, "not a JSON object").when(found != "", found).alias("detail"),
        "raw", "description", "code", "tables", "operations", "complexity",
    )
    # Exploding a one-element array keeps later filters on ``kind`` above this step. Pushed
    # below it they would repeat the whole parse for every mention of a field.
    return (
        with_defaults(typed)
        .withColumn("_problems", F.concat_ws("; ", *problems))
        .select(F.explode(F.array(row)).alias("_row"))
        .select("_row.*")
    )


@dataclass(frozen=True)
class Validated:
    good: DataFrame
    quarantine: DataFrame


def split_checked(checked: DataFrame) -> Validated:
    good = checked.filter(F.col("kind").isNull()).drop("kind", "detail", "raw")
    bad = checked.filter(F.col("kind").isNotNull()).select("path", "line_num", "kind", "detail", "raw")
    return Validated(good, bad)


@dataclass(frozen=True)
class Loaded:
    """Checked lines that are stored, good and bad, and how many of either the job that stored them has met."""

    good: DataFrame
    quarantine: DataFrame
    n_good: int
    n_bad: int


def store_checked(checked: DataFrame) -> Loaded:
    """Run the check once: one job parses each line, stores it with its verdict, and counts both kinds as it goes."""
    counts = Observation()
    bad = F.col("kind").isNotNull()
    held = stored(checked.observe(counts, F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad")), "checked")
    parts, n = split_checked(held), counts.get
    return Loaded(parts.good, parts.quarantine, n["good"], n["bad"])


def require_valid(checked: DataFrame, shown: int | None = 100) -> DataFrame:
    """The good rows, or ValidationError when there is any bad one. Lines are parsed once; what is returned reads the stored result.

    The message lists the first ``shown`` errors (None: every one); all of them are in the exception's
    ``quarantine`` table, which may be too large for a driver.
    """
    loaded = store_checked(checked)
    if loaded.n_bad:
        ordered = loaded.quarantine.orderBy("path", "line_num")
        first = (ordered if shown is None else ordered.limit(shown)).collect()
        lines = [f"Line {r.line_num}: {r.kind} error: {r.detail}" for r in first]
        more = f"\n... and {loaded.n_bad - len(first)} more" if loaded.n_bad > len(first) else ""
        raise ValidationError(f"Validation failed, {loaded.n_bad} bad lines:\n" + "\n".join(lines) + more, loaded.quarantine)
    return loaded.good


def load_examples(
    spark: SparkSession, path: str, mode: str = "failfast", code_field: str = "pyspark_code"
) -> DataFrame | Validated:
    """Read and validate examples: mode 'failfast' or 'quarantine'."""
    checked = check_examples(read_lines(spark, path), code_field)
    if mode == "failfast":
        return require_valid(checked)
    if mode == "quarantine":
        return split_checked(checked)
    raise ValueError(f"unknown mode {mode!r}")


def with_defaults(
    df: DataFrame, tables: str = "tables", operations: str = "operations", complexity: str = "complexity"
) -> DataFrame:
    """Fill absent optional fields: empty lists and the default complexity."""
    empty = F.array().cast("array<string>")
    return (
        df.withColumn("tables", F.coalesce(_col(tables), empty))
        .withColumn("operations", F.coalesce(_col(operations), empty))
        .withColumn("complexity", F.coalesce(_col(complexity), F.lit(DEFAULT_COMPLEXITY)))
    )
