"""Cutting lineage: reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df behind a checkpoint in spark.checkpoint.dir; in local mode, as in tests, in a temporary folder where that is unset."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="boxloom-"))
    return df.checkpoint()
