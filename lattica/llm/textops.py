"""Vectorised text primitives over Arrow string columns: words, 64-bit word hashes, shingles.

A *word* is a maximal run of bytes other than space and 0x09-0x0D in the UTF-8 text, so word
boundaries never cut a code point. Nulls count as empty texts. Hashes are 64 bits wide: each byte
picks a fixed random number, a word is a polynomial of those numbers, and the result is mixed.
Temporary memory follows ``SEGMENT`` and the longest word, not the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEGMENT = 1 << 19
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of uint64."""
    z = z ^ (z >> U(32))
    z = z * U(0xD6E8FEB86659FD93)
    z = z ^ (z >> U(32))
    z = z * U(0xD6E8FEB86659FD93)
    return z ^ (z >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(max(n, SEGMENT + 4096), U(base))
            step[0] = U(1)
            _powers[name] = np.cumprod(step)
    return _powers["up"], _powers["down"]


def packed(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the n+1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text indices of all words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    black = ~_WS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~black[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~black[1:]
    starts = np.flatnonzero(black & (before | cut[:-1]))
    ends = np.flatnonzero(black & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; spans are ascending and do not overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _pow(hi - lo)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(U)
        i = j
    return mix(out)


def shingles(words: np.ndarray, text: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and their text indices, in order of text; a text of 1 to n-1 words
    gives its whole sequence as one, a text without words none."""
    count = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    size = len(words)
    if not size:
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    acc = np.zeros(max(size - n + 1, 0), U)
    for k in range(n):
        acc = mix(acc + words[k : size - n + 1 + k] * U(2 * k + 3))
    whole = np.flatnonzero(text[: len(acc)] == text[n - 1 :]) if len(acc) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    extra = np.zeros(len(short), U)
    for k in range(n - 1):
        on = count[short] > k
        extra[on] = mix(extra[on] + words[first[short[on]] + k] * U(2 * k + 3) + U(count[short[on]].astype(U) << U(40)))
    value, owner = np.concatenate([acc[whole], extra]), np.concatenate([text[whole], short])
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order]


def distinct(value: np.ndarray, owner: np.ndarray, n_texts: int) -> list[np.ndarray]:
    """For each text the sorted distinct values."""
    cuts = np.searchsorted(owner, np.arange(n_texts + 1))
    return [np.unique(value[cuts[i] : cuts[i + 1]]) for i in range(n_texts)]


def shingle_sets(column: pa.Array, n: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text."""
    data, offs = packed(column)
    starts, ends, text = spans(data, offs)
    words = hashes(LOWER[data] if lower else data, starts, ends)
    return distinct(*shingles(words, text, len(column), n), len(column))


def chunks(batch: pa.RecordBatch, name: str, most: int = 4 << 20):
    """Slices of a batch with about ``most`` bytes of the named text column each, one row at least."""
    data, offs = packed(batch.column(batch.schema.get_field_index(name)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def groups(batches, keys: list[str]):
    """The groups of rows with equal keys of a sorted stream of batches, one table each; memory follows
    the largest group."""
    for table in whole(batches, keys):
        cut = np.flatnonzero(changes(table, keys))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), table.num_rows], strict=True):
            yield table.slice(a, b - a)


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row counts."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        column = table[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return new


def whole(batches, keys: list[str]):
    """A sorted stream as tables that end where a group ends."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cut = np.flatnonzero(changes(table, keys))
        if held and any(held[-1][k][-1].as_py() != table[k][0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = []
        last = int(cut[-1])
        if last:
            yield pa.concat_tables([*held, table.slice(0, last)])
            held = []
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held)
