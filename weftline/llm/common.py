"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import session

WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWEST = -(2**63)


def partitions(spark: SparkSession) -> int:
    """Number of tasks that the session deals shuffled rows to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(text: str | Column = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def document_key(doc_id: str | Column = "doc_id") -> Column:
    """The id for ordering and joining; a null id counts as one document below all others."""
    return F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long"), F.lit(LOWEST))


def text_keys(text: str | Column = "text") -> list[Column]:
    """128 bits of a text as two columns h1 and h2: with the document key they tell rows apart, unless id and text are the same."""
    c = whole_text(text)
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, spread: list[str], weights: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where few keys may own most rows.

    ``groups`` must be stored (it is read three times); its column ``weight`` says how many rows hold
    the key. With P shuffle partitions, a key above 1/P of all these rows is hot: there are fewer
    than P of those, which bounds the broadcast. A hot key is dealt over as many tasks as its
    share asks for (2P copies of group rows in all, at most), by a hash of ``spread``. Where no key
    is hot, this is a plain join. ``weights``: sum and maximum of ``weight``, if the caller knows them.
    """
    parts = partitions(rows.sparkSession)
    total, most = (w or 0 for w in weights or groups.agg(F.sum(weight), F.max(weight)).first())
    if most * parts <= total:
        return rows.join(groups.drop(weight), keys)
    share = F.ceil(F.col(weight) * parts / F.lit(max(total, 1))).cast("int")
    hot = groups.filter(F.col(weight) * parts > total).select(*keys, share.alias("_deal"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_deal").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_deal")).cast("int"))
    ).drop("_deal")
    copies = groups.withColumn(
        "_salt", F.explode(F.when(F.col(weight) * parts > total, F.sequence(F.lit(0), share - 1)).otherwise(F.array(F.lit(0))))
    ).drop(weight)
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def stored(df: DataFrame, name: str) -> DataFrame:
    """A step written to the shared scratch folder and read back; its shuffle files are given up at once.

    What follows reads the written table, so a lost executor costs nothing that was done before.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return session.stored(df, name)
    finally:
        spark.conf.set(key, before)
