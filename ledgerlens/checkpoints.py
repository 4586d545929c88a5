"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one for a local master without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the cluster's spark.checkpoint.dir; a local master without one gets a temporary folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
