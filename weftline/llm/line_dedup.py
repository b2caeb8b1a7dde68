"""Lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WS, ascii_lower, document_key, join_hot, stored, whole_text


def _lines() -> Column:
    return F.split(whole_text("_text"), "\n", -1)


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the (sorted) positions ``dropped``: the runs between them, in one pass."""
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(dropped, j - 1) + 1)
    end = lambda j: F.coalesce(F.get(dropped, j), F.size(lines))
    runs = F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda j: F.slice(lines, start(j) + 1, end(j) - start(j)))
    return F.flatten(runs)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with lines shared by many documents kept only in the largest ``doc_id`` holding them.

    A line is compared by its key: stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all their lines except those in the
    largest doc_id. ``text`` becomes the rest joined by newlines; ``n_lines`` (before) and ``n_dropped`` are added.

    Lines are exploded, hashed to 128 bits, and counted by hash with partial sums; only hashes and positions
    are shuffled. Each text moves once, to meet the positions that it loses, and is put together by position.

    Null or empty text: one empty line. Rows that repeat a doc_id count as one document, and each is cut on
    its own; a null doc_id is one document below all others. An empty table gives no rows; other columns
    stay (an input column ``n_lines`` or ``n_dropped`` is replaced).
    """
    base = docs.drop("n_lines", "n_dropped")
    keyed = base.select(F.struct("*").alias("_base"), document_key().alias("_doc"), F.col("text").alias("_text"), F.xxhash64(whole_text()).alias("_row"))
    lines = keyed.select("_doc", "_row", F.posexplode(_lines()).alias("_pos", "_line"))
    key = ascii_lower(F.btrim("_line", F.lit(WS)))
    lines = lines.select("_doc", "_row", "_pos", key.alias("_key")).filter(F.char_length("_key") >= min_chars).select(
        "_doc", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))
    shared = stored(
        lines.groupBy("_h1", "_h2").agg(F.countDistinct("_doc").alias("_docs"), F.max("_doc").alias("_last"),
                                        F.count("*").alias("_rows")).filter(F.col("_docs") >= min_docs).drop("_docs"),
        "shared-lines",
    )
    lost = join_hot(lines, shared, ["_h1", "_h2"], "_rows", ["_doc", "_pos"]).filter("_doc < _last")
    lost = lost.groupBy("_doc", "_row").agg(F.array_sort(F.collect_set("_pos")).alias("_lost"))
    out = keyed.join(lost.hint("shuffle_hash"), ["_doc", "_row"], "left")
    out = out.withColumn("_split", _lines()).withColumn("_lost", F.coalesce("_lost", F.array().cast("array<int>")))
    return out.select(
        *[F.col("_base")[c].alias(c) for c in base.columns if c != "text"],
        F.when(F.size("_lost") == 0, whole_text("_text")).otherwise(F.array_join(_without(F.col("_split"), F.col("_lost")), "\n")).alias("text"),
        F.size("_split").cast("long").alias("n_lines"), F.size("_lost").cast("long").alias("n_dropped"),
    ).select(*base.columns, "n_lines", "n_dropped")
