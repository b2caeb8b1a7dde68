"""Ids of words that come again and again: each word is encoded once, texts are put together by array operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What a pool may hold, counting for each word its characters and what an entry takes besides.
MOST_BYTES, ENTRY_BYTES = 48 << 20, 200


class _Numbers(dict):
    """Numbers of words in order of first sight; ``new`` lists those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class IdPool:
    """Remembers the ids of words; ``encode`` gives (all ids in a row, number of each word's ids) for words not seen before.

    The memory is given up when it holds about ``MOST_BYTES``.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.known, self.size = _Numbers(), 0
        self.ids = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def texts(self, split: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of words, in a row; and where each text begins (one entry more than texts)."""
        if self.size > MOST_BYTES:
            self._empty()
        counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))
        at = numbers[words.indices.to_numpy()]
        if self.known.new:
            ids, sizes = self.encode(self.known.new)
            self.size += sum(map(len, self.known.new)) + ENTRY_BYTES * len(sizes) + 4 * len(ids)
            self.known.new = []
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes.astype(np.int64)])
        sizes = self.sizes[at]
        stops = np.cumsum(sizes)
        starts = (np.cumsum(self.sizes) - self.sizes)[at]
        flat = self.ids[np.repeat(starts - (stops - sizes), sizes) + np.arange(int(sizes.sum()))]
        return flat, np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]


def lots(texts: pa.Array, most_bytes: int) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes together; a longer text is a run of its own."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield texts.slice(first, last - first)
        first = last
