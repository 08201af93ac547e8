"""Ids of many texts at once, in flat arrays (used by operator 9).

A text is split at the bytes 9-13 and 32. Equal words, known by a 64-bit hash, are encoded once: words of
ASCII and Latin-1 letters are lowered and cut into pieces by byte classes, all in numpy, and the new pieces
of one length are merged together; any other word goes through the heap of ``bpe``. What is known
of words and pieces is kept for as long as the worker lives in sorted arrays of hashes, emptied when they pass
``MOST`` bytes; this changes no result. Memory follows a batch, its longest text and ``MOST``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lattica.llm import textops
from lattica.llm.bpe import WordBpe, load

MOST = 64 << 20
LETTER, DIGIT, OTHER, ODD = 1, 2, 3, 4


def _byte_classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[65:91] = kind[97:123] = LETTER
    kind[48:58] = DIGIT
    kind[128:] = ODD
    kind[39] = ODD  # the apostrophe of endings such as 's
    return kind


_CLASS = _byte_classes()


class Runs:
    """Sorted 64-bit keys, and for each a run of ids."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def bytes(self) -> int:
        return 24 * len(self.keys) + 4 * len(self.flat)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ascending ``keys``, and which of them are known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """New keys, and their runs one after the other."""
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, flat])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], self.at[order], np.concatenate([self.size, size])[order]

    def runs(self, keys: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``keys[back]`` one after the other, and the length of each run."""
        at, _ = self.find(keys)
        size = self.size[at][back]
        return self.flat[spread(self.at[at][back], size)], size


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run of ``size``."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(first - (end - size), size) + np.arange(total)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending different keys, a place of each, and for every key its number among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


class FlatEncoder:
    def __init__(self, bpe: WordBpe, most: int = MOST):
        self.bpe, self.most = bpe, most
        self.words, self.pieces = Runs(), Runs()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the n+1 offsets of the texts in them."""
        data, offs = textops.packed(column)
        starts, ends, text = textops.spans(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        keys, place, back = distinct(textops.hashes(data, starts, ends))
        _, known = self.words.find(keys)
        if not known.all():
            if self.words.bytes() + self.pieces.bytes() > self.most:
                self.words.clear()
                self.pieces.clear()
                known[:] = False
            new = place[~known]
            self.learn(data, starts[new], ends[new], keys[~known])
        ids, size = self.words.runs(keys, back)
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(text, np.arange(len(offs)))]

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Words that are not known yet; they are given in ascending order of ``keys``."""
        size = ends - starts
        raw = data[spread(starts, size)]
        owner = np.repeat(np.arange(len(size)), size)
        kind = _CLASS[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # two bytes: a Latin-1 letter, or one of the two signs
        second = raw[lead + 1]
        kind[lead] = kind[lead + 1] = np.where((second == 0x97) | (second == 0xB7), OTHER, LETTER)
        bar = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))  # <| may begin a special token
        kind[bar] = ODD
        low = textops.LOWER[raw]
        upper = lead[(second < 0x9F) & (second != 0x97)] + 1
        low[upper] += 32
        odd = np.zeros(len(size), bool)
        odd[owner[kind == ODD]] = True

        plain = ~odd[owner]
        low, kind, owner = low[plain], kind[plain], owner[plain]
        new = np.ones(len(low), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(low))
        piece_keys, place, back = distinct(textops.hashes(low, first, last))
        _, known = self.pieces.find(piece_keys)
        fresh = place[~known]
        self.learn_pieces(low, first[fresh], last[fresh], piece_keys[~known])
        ids, lengths = self.pieces.runs(piece_keys, back)
        count = np.bincount(owner[first], lengths, len(size)).astype(np.int64)

        slow = [np.frombuffer(self.bpe.encode(data[a:b].tobytes().decode()), "<u4") for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
        count[odd] = [len(x) for x in slow]
        out = np.empty(int(count.sum()), np.uint32)
        begin = np.cumsum(count) - count
        out[spread(begin[~odd], count[~odd])] = ids
        out[spread(begin[odd], count[odd])] = np.concatenate([*slow, np.zeros(0, np.uint32)])
        self.words.add(keys, count, out)

    def learn_pieces(self, low: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray) -> None:
        size = last - first
        kept, counts, order = [], [], []
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > 48:  # few and long: the heap
                found = [np.frombuffer(self.bpe.piece(low[a : a + n].tobytes().decode()), "<u4") for a in first[rows].tolist()]
                kept.append(np.concatenate(found))
                counts.append(np.array([len(x) for x in found], np.int64))
            else:
                ids, count = self.bpe.merged_together(low[first[rows][:, None] + np.arange(n)])
                kept.append(ids[np.arange(n) < count[:, None]].astype(np.uint32))
                counts.append(count.astype(np.int64))
            order.append(rows)
        if order:
            self.pieces.add(keys[np.concatenate(order)], np.concatenate(counts), np.concatenate(kept))


_loaded: dict[str, FlatEncoder] = {}


def loaded(path: str) -> FlatEncoder:
    """One encoder a worker; what it knows lasts over the tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = FlatEncoder(load(path))
    return _loaded[path]
