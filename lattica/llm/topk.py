"""Exact top-k inner products without random access (operator 6).

Vectors become whole numbers, floor(256 * x). Rows are dealt once to blocks by a hash of their id; the queries
are copied to every block and stream past it, ``SLICE`` at a time. In a block every dimension is a list sorted
by value, read in order from its top for positive and from its bottom for negative query components.
Each stretch of the lists, from one of ``DEPTHS`` to the next, adds what its entries give to the scores so
far. A candidate's lower bound takes the worst value for each entry that is not read yet, its upper bound
the value at which the list's reading stands. Candidates whose upper bound is under the k-th best
lower bound are outsiders; reading stops for a query when at most ``FEW`` others are left, and only their
final scores are resolved. Each block gives its k best for each query, and the best k of these remain:
exact, ties to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do null ids; shorter
vectors count as padded with zeros. Repeated ids are candidates each, and an id never meets itself. An empty
table gives an empty result. Memory follows ``BLOCK`` rows and ``SLICE`` queries, not the table. Of n rows
and q queries n + q n / ``BLOCK`` are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import textops
from lattica.llm.session import lean

BLOCK, SLICE, FEW = 8192, 128, 64
DEPTHS = (0.25, 0.5, 0.75, 0.9, 1.0)


class Block:
    """The sorted lists of a block's candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: int):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        exact = float(np.abs(vectors).max(initial=0)) * largest * max(dims, 1) < 2**52
        self.number = np.float64 if exact else object
        order = np.argsort(-vectors, axis=0, kind="stable")
        rank = np.empty(order.shape, np.int32)
        np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        lists = np.take_along_axis(vectors, order, axis=0)
        self.values, self.ends = vectors.astype(self.number), np.concatenate([lists[-1], lists[0]]).astype(self.number)
        self.stretches, read = [], 0
        for depth in sorted({max(1, min(n, int(np.ceil(n * d)))) for d in DEPTHS}):
            fresh = np.hstack([(rank >= read) & (rank < depth), (rank < n - read) & (rank >= n - depth)])
            gain = np.where(fresh, np.hstack([vectors, vectors]).astype(self.number) - self.ends, 0)
            unread = np.hstack([rank >= depth, rank < n - depth]).astype(self.number)
            stands = np.concatenate([lists[min(depth, n - 1)], lists[max(n - 1 - depth, 0)]]).astype(self.number) - self.ends
            self.stretches.append((gain, unread, stands, depth == n))
            read = depth

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, id, score): the k best candidates of each query."""
        part = queries.astype(self.number)
        signed = np.vstack([np.maximum(part, 0).T, np.minimum(part, 0).T])  # read from the top, and from the bottom
        lower = np.zeros((len(self.ids), 1), self.number) + self.ends @ signed  # nothing is read: the worst of each list
        waiting, out = np.arange(len(part)), []
        for gain, unread, stands, whole in self.stretches:
            asked = signed[:, waiting]
            lower += gain @ asked
            upper = lower if whole else lower + unread @ (stands[:, None] * asked)
            left = []
            for j, q in enumerate(waiting):
                mine = np.flatnonzero(self.ids != query_ids[q])
                if not len(mine):
                    continue
                low, high = lower[mine, j], upper[mine, j]
                alive = mine[high >= np.partition(low, -k)[-k]] if len(mine) > k else mine
                if len(alive) > max(FEW, k) and not whole:
                    left.append(j)
                    continue
                score = self.values[alive] @ part[q]
                first = np.lexsort((self.ids[alive], -score))[:k]
                out.extend((int(query_ids[q]), int(self.ids[alive[i]]), int(score[i])) for i in first)
            waiting, lower = waiting[left], lower[:, left]
            if not len(waiting):
                break
        return out


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score): the k best of one block for each query."""
    block = Block(ids, vectors, float(np.abs(queries).max(initial=0)))
    return [x for lo in range(0, len(queries), SLICE) for x in block.search(query_ids[lo : lo + SLICE], queries[lo : lo + SLICE], k)]


def top_k(table: DataFrame, every: int = 50, k: int = 5, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by ``every`` the k best other rows."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.where(x.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("v"))
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(largest).alias("largest")).first()
    blocks, dims, most = max(1, -(-size["n"] // block)), max(size["d"] or 0, 1), float(size["largest"] or 0)
    held = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")

    def matrix(column) -> np.ndarray:
        out = np.zeros((len(column), dims), np.int64)
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(lists)), size)
        out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        return out

    def meet(batches):
        number, parts, now = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cut = np.flatnonzero(textops.changes(table, ["block", "asks"])).tolist()
            for a, b in zip(cut, [*cut[1:], table.num_rows], strict=True):
                rows = table.slice(a, b - a)
                if rows["block"][0].as_py() != number:
                    number, parts, now = rows["block"][0].as_py(), [], None
                if not rows["asks"][0].as_py():
                    parts.append((rows["vec_id"].to_numpy(), matrix(rows["v"])))
                    continue
                if now is None and parts:
                    now = Block(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), most)
                    parts = []
                for lo in range(0, rows.num_rows, SLICE) if now else ():
                    some = rows.slice(lo, SLICE)
                    found = np.array(now.search(some["vec_id"].to_numpy(), matrix(some["v"]), k), np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], ["query_id", "vec_id", "score"])

    ordered = held.union(asked).repartition("block").sortWithinPartitions("block", "asks")
    near = ordered.mapInArrow(lean(meet), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
