"""N-gram overlap of text pairs and the token scores made from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import tokens

MAX_N = 4


def _matches(reference: Column, candidate: Column) -> Column:
    """Grams of ``candidate`` matched in ``reference``: clipped to its counts, and all whose gram occurs there at all.

    Both lists are sorted into one, a gram's reference entries before its candidate entries, and read once.
    """
    entry = lambda side: lambda gram: F.struct(gram.alias("gram"), F.lit(side).alias("side"))
    entries = F.sort_array(F.concat(F.transform(reference, entry(0)), F.transform(candidate, entry(1))))

    def step(so_far: Column, e: Column) -> Column:
        same, asked = so_far["gram"].eqNullSafe(e["gram"]), e["side"]
        held = F.when(same, so_far["held"]).otherwise(F.lit(0)) + (1 - asked)
        used = F.when(same, so_far["used"]).otherwise(F.lit(0)) + asked
        return F.struct(
            e["gram"].alias("gram"), held.alias("held"), used.alias("used"),
            (so_far["clipped"] + F.when((asked == 1) & (used <= held), 1).otherwise(0)).alias("clipped"),
            (so_far["known"] + F.when((asked == 1) & (held > 0), 1).otherwise(0)).alias("known"),
        )

    zero = F.struct(F.lit(None).cast("string").alias("gram"), *[F.lit(0).alias(c) for c in ("held", "used", "clipped", "known")])
    return F.aggregate(entries, zero, step, lambda s: F.struct(s["clipped"].alias("clipped"), s["known"].alias("known")))


def ngram_overlap(
    pairs: DataFrame, keep: Sequence[str] = ("example_id",), reference: str = "code", candidate: str = "candidate"
) -> DataFrame:
    """Per pair: the columns to ``keep``, token counts, clipped n-gram matches for n = 1..4, and known tokens.

    Both texts of a pair are in one row, so nothing is shuffled and rows that share an id stay apart. Null counts as empty.
    """
    words = pairs.select(
        *keep, *[tokens(F.coalesce(c, F.lit(""))).alias(f"_{side}_1") for side, c in (("ref", reference), ("cand", candidate))]
    )
    for side in ("ref", "cand"):
        for n in range(2, MAX_N + 1):
            words = NGram(n=n, inputCol=f"_{side}_1", outputCol=f"_{side}_{n}").transform(words)
    found = words.select(
        *keep, F.size("_ref_1").alias("ref_len"), F.size("_cand_1").alias("cand_len"),
        *[_matches(F.col(f"_ref_{n}"), F.col(f"_cand_{n}")).alias(f"_{n}") for n in range(1, MAX_N + 1)],
    )
    return found.select(
        *keep, "ref_len", "cand_len", *[F.col(f"_{n}.clipped").alias(f"match_{n}") for n in range(1, MAX_N + 1)],
        F.col("_1.known").alias("known_tokens"),
    )


def bleu(epsilon: float = 0.1) -> Column:
    """BLEU-4 of an overlap row (Papineni et al. 2002, smoothing 1 of Chen and Cherry 2014)."""
    c, r = F.col("cand_len"), F.col("ref_len")
    log_sum = F.lit(0.0)
    for n in range(1, MAX_N + 1):
        den = F.greatest(F.lit(1), c - n + 1)
        num = F.col(f"match_{n}").cast("double")
        log_sum = log_sum + F.log(F.when(num == 0, F.lit(epsilon)).otherwise(num) / den)
    brevity = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(r, c)))
    return F.when((c == 0) | (F.col("match_1") == 0), F.lit(0.0)).otherwise(brevity * F.exp(log_sum / MAX_N))


def unigram_precision() -> Column:
    """Share of candidate tokens, repeats included, that occur in the reference; 0 without tokens."""
    return F.coalesce(F.try_divide(F.col("known_tokens"), F.col("cand_len")), F.lit(0.0))


def token_scores(
    pairs: DataFrame, key: str | Sequence[str] = "example_id", reference: str = "code", candidate: str = "candidate",
    epsilon: float = 0.1,
) -> DataFrame:
    """The key column or columns, bleu and unigram_precision of each pair."""
    keep = [key] if isinstance(key, str) else list(key)
    return ngram_overlap(pairs, keep, reference, candidate).select(
        *keep, bleu(epsilon).alias("bleu"), unigram_precision().alias("unigram_precision")
    )
