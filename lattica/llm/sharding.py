"""Sharding by a hierarchical weighted hash tree (operator 8), in DataFrame functions only.

Shards are leaves of racks, racks of regions. For each row every shard draws an exponential number, from a
hash of (id, shard) divided by the shard's weight; a rack's draw is the smallest of its shards, a region's the
smallest of its racks. So a subtree's draw is exponential with the sum of the weights in it as its rate. A row
descends from the root: at each level the child with the smallest draw wins, and the shard that gave its draw
is the one that is reached. Shards get shares in proportion to their weights. A new shard, or one of more
weight, only takes rows into itself, whether its rack and region are new or not; one of less weight only gives.

Law ``key``: the id and the number of shards decide; equal ids always meet. A null id is hashed like
any other value. Slots number the rows of a shard without gaps: rows are counted by (shard, bucket of
the id), the counts (at most shards x ``BUCKETS`` rows, broadcast up to ``FEW``) are summed, and rows are numbered
inside their bucket by (id, crc32, size); equal rows share consecutive slots in any order. A null text
counts as none: size 1, crc32 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, FEW = 1024, 1 << 18
RACKS, LEAVES = 2, 2


def tree(shards: int) -> dict[int, dict[int, list[int]]]:
    """region -> rack -> shards."""
    found: dict[int, dict[int, list[int]]] = {}
    for shard in range(shards):
        region, place = divmod(shard, RACKS * LEAVES)
        found.setdefault(region, {}).setdefault(place // LEAVES, []).append(shard)
    return found


def draw(key: Column, shard: int, weight: float = 1.0) -> Column:
    """An exponential number of rate ``weight``, decided by key and shard, and the shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard {shard}")), 11)
    number = -F.log((bits + F.lit(1)).cast("double") / F.lit(float(2**53))) / F.lit(float(weight))
    return F.struct(number.alias("draw"), F.lit(shard).alias("shard"))


def smallest(children: list[Column]) -> Column:
    """The draw of a subtree; ties to the smaller shard."""
    return F.array_min(F.array(*children)) if len(children) > 1 else children[0]


def place(key: Column, shards: int, weights: dict[int, float] | None = None) -> Column:
    """The shard of a key among ``shards`` shards; a weight is 1 where none is given."""
    weight = weights or {}
    racks = lambda r: [smallest([draw(key, s, weight.get(s, 1.0)) for s in leaves]) for leaves in r.values()]
    return smallest([smallest(racks(region)) for region in tree(shards).values()])["shard"].cast("int")


def shard(docs: DataFrame, shards: int = 8, buckets: int = BUCKETS, weights: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``."""
    key = F.col("doc_id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int").alias("bucket")
    rows = ids.select(key, (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), place(key, shards, weights).alias("shard"), place(key, shards + 1, weights).alias("grown_shard"), bucket)
    counts = ids.select(place(key, shards, weights).alias("shard"), bucket).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    small = F.broadcast(firsts) if shards * buckets <= FEW else firsts
    numbered = rows.withColumn("within", within.cast("long")).join(small, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("within") - 1).alias("slot"), "grown_shard")
