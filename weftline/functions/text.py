"""Text column functions with Unicode-aware whitespace and word classes.

Java's ``\\s``/``\\w`` and Spark's ``trim`` only know ASCII; these classes cover the
Unicode characters that Python's ``str.strip``, ``str.split`` and ``re`` treat as
whitespace or word characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
FENCE = rf"(?s)```(?:python)?{WS}*\n(.*?)```"
# The members of WS one by one, for trimming.
WS_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
# Whitespace runs other than exactly one space (those need no replacing).
_UNEVEN_WS = rf"[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}&&[^ ]]{WS}*| {WS}+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without whitespace at both ends. Only the ends are looked at, so long texts cost nothing."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def normalize_space(c: Column | str) -> Column:
    """Strip, then turn every whitespace run into one space."""
    return F.regexp_replace(strip(c), _UNEVEN_WS, " ")


def tokens(c: Column | str) -> Column:
    """Whitespace tokens, none of them empty."""
    stripped = strip(c)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"{WS}+"))


def extract_code(c: Column | str) -> Column:
    """Content of the first fenced block, or the whole text; stripped either way.

    ``regexp_extract`` gives '' for "no match" as well as for an empty block, hence the test.
    """
    c = _col(c)
    return strip(F.when(c.rlike(FENCE), F.regexp_extract(c, FENCE, 1)).otherwise(c))


def preview(c: Column | str, width: int) -> Column:
    """The first ``width`` characters followed by an ellipsis (always added)."""
    return F.concat(F.substring(_col(c), 1, width), F.lit("..."))


def tagged_preview(tag: Column | str, c: Column | str, width: int = 80) -> Column:
    return F.concat(F.lit("["), _col(tag), F.lit("] "), preview(c, width))


def fixed4(x: Column | str) -> Column:
    """A score in [0, 1] with four decimals, rounded on its exact binary value, ties to even.

    ``format_string('%.4f')`` rounds the shortest decimal form half up instead, and so
    prints 1/32 as 0.0313 where 0.0312 is right. Here x * 2^80 is a whole number (of any x
    that does not round to 0), taken in two steps because it exceeds 64 bits.
    """
    high_bits, low_bits = 2**60, 2**20

    def number(value: int, digits: int) -> Column:
        return F.lit(str(value)).cast(f"decimal({digits},0)")

    x = _col(x) * F.lit(float(high_bits))
    high = x.cast("bigint")
    low = ((x - high.cast("double")) * F.lit(float(low_bits))).cast("bigint")
    whole_x = high.cast("decimal(19,0)") * number(low_bits, 7) + low.cast("decimal(7,0)")
    scaled, unit = whole_x * number(10000, 5), number(high_bits * low_bits, 25)
    rest = scaled % unit
    whole = ((scaled - rest) / unit).cast("bigint")
    half = number(high_bits * low_bits // 2, 25)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    n = whole + up.cast("bigint")
    return F.concat(F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))
