"""Connected components of links between 64-bit ids, by repeated contraction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.session import lean


class Forest:
    """Union-find over whole numbers below n; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _local(batches):
    """The links of one partition as links to the smallest node of each local component."""
    parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.concat_tables(parts)
    ends = np.concatenate([table["a"].to_numpy(), table["b"].to_numpy()])
    nodes, index = np.unique(ends, return_inverse=True)
    forest, half = Forest(len(nodes)), table.num_rows
    for x, y in zip(index[:half].tolist(), index[half:].tolist(), strict=True):
        forest.join(x, y)
    roots = np.array([forest.find(x) for x in range(len(nodes))])
    on = roots != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(nodes[roots[on]])], ["a", "b"])


FINISH = 1 << 19


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round points every node at its smallest neighbour and keeps the links between the targets; a
    round at least halves the nodes that are left. At most ``FINISH`` links, a fixed 8 MB, are finished
    by one task on an executor. Rounds are cut by checkpoint(). Null ends and loops are ignored.
    """
    ordered = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = ordered(ordered(links).mapInArrow(lean(_local), "a long, b long")).checkpoint()
    levels: list[DataFrame] = []
    while (size := left.count()) > 0:
        if size <= FINISH:
            done = left.coalesce(1).mapInArrow(lean(_local), "a long, b long").checkpoint()
            roots = done.select("b").distinct()
            levels.append(done.union(roots.select("b", "b")).toDF("node", "p"))
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("p")).checkpoint()
        levels.append(up)
        pa_, pb_ = up.select(F.col("node").alias("a"), F.col("p").alias("pa")), up.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = left.join(pa_, "a").join(pb_, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        chained = up.select(F.col("p").alias("a")).distinct().join(pa_, "a").select("a", F.col("pa").alias("b"))
        left = ordered(moved.union(chained)).checkpoint()
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)

    def composed(below: DataFrame, above: DataFrame) -> DataFrame:
        top = above.select(F.col("node").alias("p"), F.col("p").alias("q"))
        return below.join(top, "p", "left").select("node", F.coalesce("q", "p").alias("p"))

    return reduce(composed, levels).select("node", F.col("p").alias("root"))
