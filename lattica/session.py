"""The session setting that iterative plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Use the checkpoint folder that the cluster names; set a local one only where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return spark
