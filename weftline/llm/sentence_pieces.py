"""SentencePiece encoding and decoding: the best segmentation of whole batches of words at a time."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.llm.idpool import IdPool, lots

MARK = "▁"
UNKNOWN_PENALTY = 10.0
BATCH_BYTES = 1 << 22
CELLS = 1 << 18
FIRST_BITS = 20

_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_UNIGRAM = 1
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a model file, with log probabilities.

    A unigram model brings its scores. Other models bring an order; their pieces get Zipf's law over it, so that p(rank) is in
    proportion to 1 / (rank + 2).
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("models with a character map, or that drop white space, are not supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        kinds = np.array([p.type for p in proto.pieces])
        usable = np.flatnonzero((kinds == _NORMAL) | (kinds == _USER))
        if proto.trainer_spec.model_type == _UNIGRAM:
            scores = np.array([proto.pieces[i].score for i in usable], np.float32)
        else:
            odds = 1 / (np.arange(len(usable)) + 2.0)
            scores = np.log(odds / odds.sum()).astype(np.float32)
        self.scores = dict(zip(usable.tolist(), scores.tolist()))
        self.unknown = int(np.flatnonzero(kinds == _UNKNOWN)[0])
        self.unknown_score = np.float32(scores.min() - UNKNOWN_PENALTY)
        self.bytes = {int(self.pieces[i][1:-1], 16): int(i) for i in np.flatnonzero(kinds == _BYTE)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = frozenset(np.flatnonzero(kinds == _CONTROL).tolist())
        if any(MARK in self.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("pieces that reach over a space are not supported")
        self.longest = max(len(self.pieces[i]) for i in usable)
        keys = np.zeros(len(usable), np.uint64)
        lengths = np.array([len(self.pieces[i]) for i in usable])
        for size in np.unique(lengths):
            same = np.flatnonzero(lengths == size)
            codes = np.frombuffer("".join(self.pieces[usable[i]] for i in same).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
            for c in codes.T:
                keys[same] = _step(keys[same], c)
        order = np.argsort(keys)
        self.keys, self.ids, self.key_scores = keys[order], usable[order], scores[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        # where the keys that share their first bits begin, and the most that do
        self.begin = np.searchsorted(self.keys, np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(64 - FIRST_BITS)).astype(np.int32)
        self.probes = int(np.diff(np.append(self.begin, len(self.keys))).max())
        self.padded = np.append(self.keys, np.full(self.probes, 0, np.uint64))
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.shown[self.unknown] = " \u2047 "
        for i in self.silent:
            self.shown[i] = ""
        for i, b in self.byte_of.items():
            self.shown[i] = chr(b)
        self.in_many = np.isin(np.arange(len(self.pieces)), [i for i, b in self.byte_of.items() if b > 127])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index among the sorted keys of each hash, -1 where there is none."""
        at = self.begin[hashes >> np.uint64(64 - FIRST_BITS)]
        out = np.where(self.padded[at] == hashes, at, -1)
        for probe in range(1, self.probes):
            hit = self.padded[at + probe] == hashes
            if hit.any():
                out[hit] = at[hit] + probe
        return out


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return _spread((h + codes.astype(np.uint64) + np.uint64(1)) * _HASH)


def best_paths(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For words of equal length (rows of code points): back-pointers and pieces of the best way to each end.

    back[:, e] is the length of the last piece of the best segmentation of the first e characters, key[:, e] that piece (-1: unknown
    character). Of equal sums the longer last piece wins.
    """
    n, length = codes.shape
    best = np.zeros((n, length + 1), np.float32)
    back, key = np.zeros((n, length + 1), np.int16), np.full((n, length + 1), -1, np.int32)
    reach = min(length, pieces.longest)
    # hashes of the substrings that end at the current place, by their start; one character more at each step
    found = np.full((n, length + 1, reach), -1, np.int32)
    h = np.zeros((n, length), np.uint64)
    for size in range(1, reach + 1):
        starts = length - size + 1
        h = _step(h[:, :starts], codes[:, size - 1 :])
        found[:, size:, size - 1] = pieces.find(h)
    for end in range(1, length + 1):
        most = min(end, reach)
        sizes = np.arange(most, 0, -1)
        at = found[:, end, sizes - 1]
        sums = best[:, end - sizes] + np.where(at >= 0, pieces.key_scores[at], -np.inf).astype(np.float32)
        sums[:, -1] = np.where(at[:, -1] >= 0, sums[:, -1], best[:, end - 1] + pieces.unknown_score)
        pick = sums.argmax(axis=1)
        rows = np.arange(n)
        best[:, end], back[:, end], key[:, end] = sums[rows, pick], sizes[pick], at[rows, pick]
    return back, key


class Encoder:
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.pool = IdPool(self._segment)
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _unknown(self, char: str) -> list[int]:
        p = self.pieces
        return [p.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if p.bytes else [p.unknown]

    def _segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has; those of equal length are segmented together."""
        if self.pieces.prefix:
            chunks = [c if c.startswith(MARK) else MARK + c for c in chunks]
        by_length: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by_length.setdefault(len(c), []).append(i)
        parts, owners = [], []
        for length, same in by_length.items():
            lot = max(1, CELLS // (length * min(length, self.pieces.longest)))
            for i in range(0, len(same), lot):
                rows = same[i : i + lot]
                codes = np.frombuffer("".join([chunks[r] for r in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), length)
                ids = self._follow(*best_paths(codes, self.pieces), codes)
                parts.append(ids[ids >= 0])
                owners.append(np.repeat(rows, (ids >= 0).sum(axis=1)))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(parts)[order], np.bincount(owner, minlength=len(chunks))

    def _follow(self, back: np.ndarray, key: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The ids along the back-pointers of each row, in reading order; -1 where a row has no more."""
        n, rows = len(back), np.arange(len(back))
        end = np.full(n, back.shape[1] - 1)
        steps = []
        while end.any():
            at = key[rows, end]
            ids = np.where(end > 0, np.where(at >= 0, self.pieces.ids[at], -2), -1)
            strange = np.flatnonzero(ids == -2)
            if len(strange):
                many = [self._unknown(chr(c)) for c in codes[strange, end[strange] - 1]]
                wide = np.full((max(map(len, many)), n), -1, np.int64)
                wide[0] = ids
                for r, out in zip(strange.tolist(), many):
                    wide[: len(out), r] = out[::-1]
                steps.extend(wide)
            else:
                steps.append(ids)
            end = end - back[rows, end]
        return np.stack(steps[::-1], axis=1)

    def _chunks(self, text: str) -> list[str]:
        """The text cut before each run of marks. With a mark before the text, a chunk's single first mark is left off."""
        if not self.pieces.prefix:
            return self.chunk.findall(text.replace(" ", MARK))
        found = self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []
        return [c[1:] if len(c) > 1 and c[1] != MARK else c for c in found]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Piece ids of each text. Texts whose spaces stand alone between words are split at them; others are cut by the rule."""
        plain = pc.invert(pc.match_substring_regex(texts, f"  |^ | $|{MARK}|^$")) if self.pieces.prefix else pa.array([False] * len(texts))
        ids, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        count = pc.sum(plain).as_py() or 0
        sorted_texts = texts.take(pa.array(order))
        for part, split in ((sorted_texts.slice(0, count), lambda t: pc.split_pattern(t, " ")),
                            (sorted_texts.slice(count), lambda t: pa.array([self._chunks(x) for x in t.to_pylist()], pa.list_(pa.string())))):
            for lot in lots(part, BATCH_BYTES):
                flat, begins = self.pool.texts(split(lot))
                ends.append(begins[1:] + ends[-1][-1])
                ids.append(flat)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)))
        return lists.take(pa.array(np.argsort(order, kind="stable")))

    def decode(self, ids: np.ndarray) -> str:
        p = self.pieces
        if not p.in_many[ids].any():
            text = "".join(map(p.shown.__getitem__, ids.tolist()))
        else:
            out, raw = [], bytearray()
            for i in [*ids.tolist(), None]:
                b = p.byte_of.get(i)
                if b is not None:
                    raw.append(b)
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                if i is not None:
                    out.append(p.shown[i])
            text = "".join(out)
        return text[1:] if p.prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def encode(text: Column, model: str) -> Column:
    """Piece ids (array of int) of a text column under the SentencePiece file ``model``; null for null, empty for empty.

    Spaces become the mark, one mark is put before the text if the model asks for it, and the text is cut before each run of marks, which no piece reaches over.
    Every cut is segmented into the pieces of greatest summed log probability. A character without piece becomes its bytes, or the unknown id.
    """
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        done = encoder(model).encode(pc.fill_null(texts, ""))
        return pc.if_else(texts.is_valid(), done, pa.scalar(None, done.type)) if texts.null_count else done

    return ids(text)


def decode(ids: Column, model: str) -> Column:
    """The text of piece ids; null for null, and null ids in a list are passed over. Ids made by ``encode`` give the text back, except that marks in it become spaces."""
    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        back = encoder(model).decode
        return pa.array([back(x.values.drop_null().to_numpy()) if x.is_valid else None for x in lists], pa.string())

    return text(ids)
