"""Documents packed into token sequences of fixed length by first-fit decreasing."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions, stored, whole_text
from weftline.llm.idpool import IdPool, lots

GROUP_PIECES = 1 << 15
BATCH_BYTES = 1 << 22
MOST_MARKS = 50_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


_SIMPLE = re.compile(r"([^\W\d_]+)([!-,./:;?|]*)")


class _Words:
    """Ids of single words. Letters with or without punctuation after them go to the BPE model at once; other words go through the tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.marks: dict[str, list[int]] = {}
        # How byte-level models write bytes as characters; printable ones stand for themselves.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.written = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}

    def _letters(self, part: str) -> list[int]:
        text = part if part.isascii() else "".join(map(self.written.__getitem__, part.encode()))
        return [t.id for t in self.model.tokenize(text)]

    def _marks(self, part: str) -> list[int]:
        ids = self.marks.get(part)
        if ids is None:
            ids = self.marks[part] = [t.id for t in self.model.tokenize(part)]
        return ids

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.marks) > MOST_MARKS:
            self.marks = {}
        out, hard = [], []
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                out.append(self._letters(w.lower()))
                continue
            m = _SIMPLE.fullmatch(w)
            if m and m[1].isalpha() and is_normalized("NFC", w) and "\u03a3" not in w and "\u0130" not in w:
                out.append(self._letters(m[1].lower()) + self._marks(m[2]) if m[2] else self._letters(m[1].lower()))
            else:
                hard.append(i)
                out.append([])
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([words[i] for i in hard], add_special_tokens=False)):
            out[i] = e.ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(sizes.sum())), sizes


@lru_cache(maxsize=1)
def _word_ids(path: str) -> IdPool:
    """One for each task at work. The tokenizer splits at white space before anything else, so a text's ids are its words' ids in a row.

    Only space and newline are used to split; any other character stays for the tokenizer.
    """
    return IdPool(_Words(path))


def token_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each begins.

    Fewer words are distinct in lower case and without the point or comma after them; the tokenizer lower-cases and cuts there, too.
    """
    texts = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
    texts = pc.replace_substring_regex(texts, r"(\pL)([.,]) ", r"\1 \2 ")
    return _word_ids(path).texts(pc.split_pattern(texts, " "))


def _pieces(tokenizer: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        try:
            yield from pieces(batches, end)
        finally:
            # The worker lives on after the task; its memory of words does not.
            _word_ids.cache_clear()

    def pieces(batches: Iterator[pa.RecordBatch], end: bytes) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, at = batch.column(0).to_pylist(), [], 0
            for texts in lots(batch.column(1), BATCH_BYTES):
                ids, begins = token_ids(tokenizer, texts)
                raw = ids.astype("<u4").tobytes()
                for doc, b, e in zip(docs[at : at + len(texts)], begins[:-1].tolist(), begins[1:].tolist()):
                    whole = raw[4 * b : 4 * e] + end
                    n = e - b + 1
                    rows += [(doc, s, min(length, n - s), zlib.crc32(whole[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                at += len(texts)
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item (none longer than ``capacity``).

    A tournament tree over the bins keeps in each node the most room below it, so the first bin with
    room for an item is found by walking down from the root.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def _pack(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="_group").assign(sequence_id=(key[0] << 32) + bins, offset=offsets)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``length`` tokens; one row per piece.

    ``tokenizer`` is the file of a lower-casing word BPE that drops white space; each document's ids are
    followed by ``end_id``. A document longer than ``length`` is cut every ``length`` tokens. The pieces (numbers only,
    the texts are not moved) are dealt by a hash, in which pieces alike have numbers of their own, to random groups of about ``group_pieces``, and each group is packed by
    first-fit decreasing. ``sequence_id`` is the group's number times 2^32 plus the bin.

    Null or empty text is the end id alone. Repeated rows are packed again each, in any order among themselves;
    a null doc_id stays null. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
    pieces = stored(texts.mapInArrow(_pieces(tokenizer, length, end_id), PIECES), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.repartition(min(groups, partitions(spark)), "_group").groupBy("_group").applyInPandas(_pack(length), PACKED)
