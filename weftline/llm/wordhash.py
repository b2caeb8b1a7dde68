"""64-bit hashes of words and of runs of words, for whole batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
# Bytes that are hashed at a time, unless one text is longer, and powers that a task keeps, of the base and of its inverse.
_BLOCK, _KEPT = 1 << 17, 1 << 18
_powers = {base: np.ones(1, np.uint64) for base in (_BASE, _UNBASE)}
# Bytes with A-Z lower-cased, and whether a byte is white space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = bytes(b == 32 or 9 <= b <= 13 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first n powers of an odd base modulo 2^64."""
    known = _powers[base]
    if len(known) < n:
        steps = np.full(max(n, min(2 * len(known), _KEPT)), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps)
        if len(known) <= _KEPT:
            _powers[base] = known
    return known[:n]


def words(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run without ASCII white space) of all texts, and where each text's words begin.

    ``lower`` lower-cases A-Z first. The second array has one entry more than there are texts.
    """
    found, begins, lot, size = [], [np.zeros(1, np.int64)], [], 0
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, r in enumerate(raw):
        lot.append(r)
        size += len(r)
        if i + 1 == len(raw) or size + len(raw[i + 1]) > _BLOCK:
            hashed, ends = _hashed(lot, lower)
            begins.append(ends + begins[-1][-1])
            found.append(hashed)
            lot, size = [], 0
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate(begins)


def _hashed(raw: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words end."""
    ends = np.cumsum([len(r) + 1 for r in raw])
    joint = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joint.translate(_LOWER) if lower else joint, np.uint8)
    space = np.frombuffer(joint.translate(_SPACE), np.bool_)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate([[0], edge]) if not space[0] else edge
    starts, stops = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    # The sum of a word's bytes times powers that begin anew with it, from sums of all bytes so far.
    sums = data.astype(np.uint64)
    sums += np.uint64(1)
    sums *= powers(len(data))
    np.cumsum(sums, out=sums)
    before = sums[np.maximum(starts - 1, 0)]
    before[0] = before[0] if starts[0] else 0
    hashed = (sums[stops - 1] - before) * powers(len(data), _UNBASE)[starts]
    return mix(hashed + (stops - starts).astype(np.uint64)), np.searchsorted(starts, ends)


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of a run from the hashes of its two parts, in order."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + mix(b + np.uint64(salt)))


def runs(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of n successive words (len(hashes) - n + 1 of them), by doubling."""
    out, size = None, 0
    power, length = hashes, 1
    while length <= n:
        if n & length:
            if out is None:
                out, size = power, length
            else:
                m = max(0, min(len(out), len(power) - size))
                out = joined(out[:m], power[size : size + m], salt + size + length)
                size += length
        length *= 2
        if length <= n:
            m = max(0, len(power) - length // 2)
            power = joined(power[:m], power[length // 2 :], salt + length)
    return out[: max(0, len(hashes) - n + 1)]


def chunks(rows: list[tuple], text_at: int) -> Iterator[list[tuple]]:
    """Rows in lots of about ``CHUNK_BYTES`` of text (a longer text is a lot of its own)."""
    lot, size = [], 0
    for row in rows:
        if lot and size + len(row[text_at]) > CHUNK_BYTES:
            yield lot
            lot, size = [], 0
        lot.append(row)
        size += len(row[text_at])
    if lot:
        yield lot
