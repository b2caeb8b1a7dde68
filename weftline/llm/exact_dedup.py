"""Exact copies, found through a minimal perfect hash over the digests of what is already there."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWEST, document_key, join_hot, stored, whole_text

BUCKET_DIGESTS = 1 << 16

INDEX_SCHEMA = "_bucket long, sizes array<long>, bits binary, digests binary, keep array<long>, row array<long>, chars array<long>, copies array<long>"
GROUP_SCHEMA = "_digest binary, keep_id long, keep_row long, group_size long, member boolean"


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text without ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", ""), 256))


# -- the minimal perfect hash: levels of bits; a key owns the first level where its bit is its own --------


def _words(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    x = words[:, level % 4] + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the bits of all levels for n distinct digests; n bits are set."""
    sizes, bits, level = [], [], 0
    while len(words):
        size = max(8, math.ceil(len(words) * 1.3))
        at = _place(words, level, size)
        own = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(own)
        words = words[~own[at]]
        level += 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has a bit for it. A stranger may get some slot, too."""
    rank = np.cumsum(bits) - 1
    slots, todo, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _place(words[todo], level, size)
        hit = bits[at]
        slots[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + size
    return slots


def _build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    digests = pdf["_digest"].to_numpy()
    words = _words(digests)
    sizes, bits = build_hash(words)
    order = np.argsort(find_slots(words, sizes, bits))
    return pd.DataFrame([{
        "_bucket": key[0], "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": b"".join(digests[order]),
        "keep": pdf["_id"].to_numpy()[order], "row": pdf["_row"].to_numpy()[order], "chars": pdf["_chars"].to_numpy()[order], "copies": pdf["_n"].to_numpy()[order],
    }])


def _probe(key: tuple, new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Look the new digests up: repeats are merged into their slot, the others come out as groups of their own."""
    digests, n = new["_digest"].to_numpy(), new["_n"].to_numpy(np.int64)
    ids, rows, chars = (new[c].to_numpy(np.int64) for c in ("_id", "_row", "_chars"))
    repeat = np.zeros(len(new), bool)
    parts = []
    if len(index):
        entry = index.iloc[0]
        bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=int(sum(entry["sizes"]))).astype(bool)
        held = np.frombuffer(entry["digests"], "V32")
        keep, kept_row, most, copies = (np.array(entry[c], np.int64) for c in ("keep", "row", "chars", "copies"))
        slots = find_slots(_words(digests), list(entry["sizes"]), bits) if len(new) else np.zeros(0, np.int64)
        repeat = np.array([s >= 0 and held[s].tobytes() == d for s, d in zip(slots, digests)], bool)
        at = slots[repeat]
        same = (chars[repeat] == most[at]) & (ids[repeat] == keep[at])
        better = (chars[repeat] > most[at]) | ((chars[repeat] == most[at]) & (ids[repeat] < keep[at])) | (same & (rows[repeat] < kept_row[at]))
        keep[at] = np.where(better, ids[repeat], keep[at])
        kept_row[at] = np.where(better, rows[repeat], kept_row[at])
        most[at] = np.where(better, chars[repeat], most[at])
        copies[at] += n[repeat]
        parts.append(pd.DataFrame({"_digest": [h.tobytes() for h in held], "keep_id": keep, "keep_row": kept_row, "group_size": copies, "member": True}))
    alone = ~repeat
    parts.append(pd.DataFrame({"_digest": digests[alone], "keep_id": ids[alone], "keep_row": rows[alone], "group_size": n[alone], "member": False}))
    return pd.concat([p for p in parts if len(p)]) if any(len(p) for p in parts) else parts[0]


def _groups(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per digest: rows, and the winner (most code points, then smallest id, then first row). Sums start before the shuffle."""
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_doc").alias("d"), F.col("_at").alias("r")))
    return rows.groupBy("_digest").agg(F.count("*").alias("_n"), best.alias("_best")).select(
        "_digest", "_n", F.col("_best.d").alias("_id"), F.col("_best.r").alias("_row"), (-F.col("_best.c")).alias("_chars"),
        F.pmod(F.xxhash64("_digest"), F.lit(buckets)).alias("_bucket"))


def exact_copies(docs: DataFrame, historical: Column) -> DataFrame:
    """For each row of ``docs`` the row that stays of its equal texts; rows where ``historical`` holds came before.

    Texts are equal when they are without ASCII white space. Of equal texts stays the row with the most code
    points in the original text, then the smallest doc_id. Returns, for each row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``digest`` (binary) and ``in_history`` (some historical row has the text).

    The distinct historical digests are dealt to buckets of about 65,536; each bucket is a minimal perfect
    hash whose slots hold full digests and the place of the winner. New digests, one row for all
    copies, are looked up in their bucket and compared byte by byte. Repeats join the slot's group; the others
    form groups of their own. Rows then learn their group; large groups are dealt over many tasks.

    Null text counts as empty, a null doc_id as the smallest (it comes out null). Of rows that repeat both doc_id and
    length of the winner, or lack an id alike, one is kept: each row is numbered, and the first one stays. No rows give no rows. Only doc_id, text and
    what ``historical`` names are read, so other columns cannot clash.
    """
    narrow = stored(docs.select(
        document_key().alias("_doc"), F.char_length(whole_text()).cast("long").alias("_chars"),
        text_digest(F.col("text")).alias("_digest"), F.coalesce(historical, F.lit(False)).alias("_old"),
        F.monotonically_increasing_id().alias("_at"),
    ), "digests")
    buckets = max(1, math.ceil(narrow.count() / BUCKET_DIGESTS))
    index = stored(_groups(narrow.filter("_old"), buckets).groupBy("_bucket").applyInPandas(_build, INDEX_SCHEMA), "digest-index")
    new = _groups(narrow.filter("not _old"), buckets)
    groups = stored(new.groupBy("_bucket").cogroup(index.groupBy("_bucket")).applyInPandas(_probe, GROUP_SCHEMA), "digest-groups")
    out = join_hot(narrow, groups.withColumn("_weight", F.col("group_size")), ["_digest"], "_weight", ["_at"])
    plain = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select(
        plain("_doc").alias("doc_id"), plain("keep_id").alias("keep_id"), "group_size",
        (F.col("_at") == F.col("keep_row")).alias("kept"),
        F.col("_digest").alias("digest"), F.col("member").alias("in_history"),
    )
