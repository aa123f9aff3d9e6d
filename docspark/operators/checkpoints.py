"""Cutting lineage, through the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a session of one machine may go without one; it gets one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docspark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
