"""Weights for vectors of word counts, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import _col


def bucket_weights(df: DataFrame, counts: str, dim: int) -> list[float]:
    """What a word of each bucket is worth: ln((1 + n) / (1 + texts with a word of it)), n being the rows with a vector of counts.

    One pass with partial sums; ``dim`` numbers come to the driver.
    """
    row = df.agg(F.count(counts).alias("n"), *[F.count_if(F.get(counts, F.lit(b)) > 0).alias(f"b{b}") for b in range(dim)]).first()
    return [math.log((1 + row["n"]) / (1 + row[f"b{b}"])) for b in range(dim)]


def weighted_counts(counts: Column | str, weights: Sequence[float]) -> Column:
    """Counts by bucket, times the weight of the bucket; null for a null vector."""
    worth = F.array(*[F.lit(float(w)) for w in weights])
    return F.zip_with(_col(counts), worth, lambda n, w: n.cast("double") * w)
