"""Per-row scores of a candidate against its reference, as column expressions.

Everything here is row-local and runs inside the JVM: scoring adds no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import WORD, WS, _col, normalize_space

# The words counted as operations, found by case-sensitive substring test.
OPERATIONS = (
    "select", "filter", "where", "groupBy", "agg", "join", "orderBy", "sort",
    "withColumn", "drop", "distinct", "union", "limit", "alias", "Window", "partitionBy",
    "over", "when", "otherwise", "col", "lit", "count", "sum", "avg",
    "max", "min", "collect_list", "collect_set", "explode", "split", "coalesce", "broadcast",
)

# Method names before "(", quoted literals, names after "F.".
PATTERNS = (
    rf"\.({WORD}+){WS}*\(",
    "[\"']([^\"']+)[\"']",
    rf"F\.({WORD}+)",
)


def exact_match(reference: Column | str, candidate: Column | str) -> Column:
    return normalize_space(reference) == normalize_space(candidate)


def operations_in(code: Column | str) -> Column:
    """Operation words occurring in the text, in list order."""
    code = _col(code)
    return F.filter(F.array(*[F.lit(w) for w in OPERATIONS]), lambda w: F.contains(code, w))


def _count_true(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests])


def operation_coverage(reference: Column | str, candidate: Column | str) -> Column:
    """Share of the reference's operations found in the candidate; 1 when it has none.

    Written as a sum of substring tests, which compiles to straight code with no arrays.
    """
    ref, cand = _col(reference), _col(candidate)
    wanted = _count_true([ref.contains(w) for w in OPERATIONS])
    found = _count_true([ref.contains(w) & cand.contains(w) for w in OPERATIONS])
    return F.when(wanted == 0, F.lit(1.0)).otherwise(F.try_divide(found, wanted))


def patterns_in(code: Column | str) -> Column:
    """Distinct method names, quoted literals and F-function names of the text."""
    code = _col(code)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), 1) for p in PATTERNS]))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(F.try_divide(both, either))


def structural_similarity(reference: Column | str, candidate: Column | str) -> Column:
    return jaccard(patterns_in(reference), patterns_in(candidate))
