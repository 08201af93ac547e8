"""Bounded samples of labelled rows, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col):
    """Rows whose crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], float]:
    """At most ``rows`` training texts of each class, the classes, and the share of label 1 among all
    training labels.

    Ids are drawn by a hash of the id from the labels alone; the drawn ids (at most 2 x ``rows``) are
    broadcast to the documents. Of texts with one id the smallest is taken, so that the sample is the same in
    each run; a null text counts as none. Labels other than 0 and 1, null ids and repeated labels are ignored.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    count = known.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows)
        drawn = part if drawn is None else drawn.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toArrow()
    order = sorted(range(found.num_rows), key=found["id"].to_pylist().__getitem__)
    text, y = found["text"].to_pylist(), found["y"].to_pylist()
    share = (count["ones"] or 0) / count["n"] if count["n"] else 0.5
    return [text[i] for i in order], [y[i] for i in order], share
