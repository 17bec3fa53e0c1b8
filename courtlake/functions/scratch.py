"""Cutting a lineage that many branches read, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; a folder of its own is made only in a local session that names none."""
    spark = frame.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="courtlake-checkpoint-"))
    return frame.checkpoint(eager=True)
