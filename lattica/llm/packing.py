"""Packing into fixed windows by Karmarkar-Karp multiway differencing (operator 9).

Whole windows are cut from long texts. What is left of each text waits in a pool. A pool is full at
``POOL`` windows of tokens; the piece that passes this mark is cut there, and what is left of it opens the
next pool. A full pool is partitioned: every piece starts as a partition of its own into k windows, the
two partitions with the largest differences are merged, the heaviest windows of one onto the
lightest of the other, until one is left. Its windows are near equal. The few tokens by which a window
is over capacity are cut off and fill windows with room; where the capacity of all k is exceeded, k
goes up by one and the differencing runs again.

Every partition of the input packs its own texts in order, so nothing is shuffled, memory follows
one batch, one pool and the ids of the longest text, and a task that runs again gives the same rows; the
last pool of a partition ends with a window that may be short. Null texts count as empty (they still have
the closing id); repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import bpe, flat, textops
from lattica.llm.session import lean

POOL = 128


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Partition the indices of ``sizes`` into k groups of near-equal sums."""
    joined: list[tuple[int, int]] = []
    n = len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums, held = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], held[0] = size, i
        heap.append((-size, i, sums, held))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, a_held = heapq.heappop(heap)
        _, _, b, b_held = heapq.heappop(heap)
        sums, other = a + b[::-1], b_held[::-1]
        held = np.where(a_held < 0, other, a_held)
        both = np.flatnonzero((a_held >= 0) & (other >= 0))
        if len(both):
            held[both] = n + len(joined) + np.arange(len(both))
            joined.extend(zip(a_held[both].tolist(), other[both].tolist(), strict=True))
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        sums -= sums[-1]
        serial += 1
        heapq.heappush(heap, (-int(sums[0]), serial, sums, held))
    groups = []
    for top in heap[0][3].tolist() if heap else []:
        group, todo = [], [top] if top >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                group.append(x)
            else:
                todo.extend(joined[x - n])
        groups.append(sorted(group))
    return groups


def windows(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of at most ``capacity``: (index, first, length) of what lies in each; every size is 1 to
    ``capacity``. All of a size lies in one window, but for overhangs."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while True:
        groups = [[(i, 0, sizes[i]) for i in g] for g in differencing(sizes, k)]
        room = [capacity - sum(n for _, _, n in g) for g in groups]
        if sum(room) >= 0:
            break
        k += 1
    open_ = [j for j, r in enumerate(room) if r > 0]
    for j, over in enumerate(room):
        while over < 0:  # the overhang of the longest piece moves to windows with room
            at = max(range(len(groups[j])), key=lambda x: groups[j][x][2])
            i, first, n = groups[j][at]
            cut = min(-over, room[open_[-1]], n)
            groups[j][at : at + 1] = [(i, first, n - cut)] * (n > cut)
            groups[open_[-1]].append((i, first + n - cut, cut))
            room[open_[-1]] -= cut
            over += cut
            if not room[open_[-1]]:
                open_.pop()
    return [g for g in groups if g]


def encoded(encoder: flat.FlatEncoder, batch):
    """(id, ids) of each row, a few megabytes of text at a time."""
    for part in textops.chunks(batch, "text"):
        ids, cut = encoder.encode(part.column(1))
        for doc, a, b in zip(part.column(0).to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield doc, ids[a:b].astype("<u4").tobytes()


def pack(docs: DataFrame, capacity: int = 2048, closing: int = 1, vocab: str | None = None, keep: bool = False, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into sequences of at most ``capacity`` tokens.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``keep`` the
    ids (binary, little-endian unsigned 32-bit).
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep

    full = pool * capacity

    def run(batches):
        encoder = flat.loaded(vocab or bpe.vocabulary())
        end = np.array([closing], "<u4").tobytes()
        serial = TaskContext.get().partitionId() << 33
        out: list[list] = [[] for _ in names]
        waiting: list[tuple] = []
        held = 0

        def put(doc, start, ids, doc_tokens, sequence, offset):
            values = (doc, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence, offset, ids)
            for column, value in zip(out, values, strict=False):
                column.append(value)

        def flush():
            nonlocal serial, held
            for group in windows([len(p[2]) // 4 for p in waiting], capacity):
                at = 0
                for i, first, size in group:
                    doc, start, ids, doc_tokens = waiting[i]
                    put(doc, start + first, ids[4 * first : 4 * (first + size)], doc_tokens, serial, at)
                    at += size
                serial += 1
            waiting.clear()
            held = 0

        def rows():
            cols = [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for c, name in zip(out, names, strict=True)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for doc, ids in encoded(encoder, batch):
                ids += end
                n = len(ids) // 4
                start = n // capacity * capacity
                for whole in range(0, start, capacity):
                    put(doc, whole, ids[4 * whole : 4 * (whole + capacity)], n, serial, 0)
                    serial += 1
                while start < n:
                    size = min(n - start, full - held)
                    waiting.append((doc, start, ids[4 * start : 4 * (start + size)], n))
                    held += size
                    start += size
                    if held == full:
                        flush()
            yield rows()
        flush()
        yield rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)
