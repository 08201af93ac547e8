"""Session settings that the operators of this subpackage rely on."""

from __future__ import annotations

import ctypes
import tempfile
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches to ``BATCH_ROWS`` rows; keep the cluster's checkpoint folder and set a local
    one only where none is set, as in tests."""
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return spark


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of each execution inside go when it ends, and not only when the driver happens to collect its
    garbage; for work cut by checkpoint(), that reads none of them again. Spark before 4.1 ignores the setting."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lean(run):
    """``run`` over the batches of a task, which then gives freed memory back: workers outlive their tasks,
    and an executor counts what they hold."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped
