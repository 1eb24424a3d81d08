"""Rows written to the shared checkpoint folder, so that a lost executor costs running tasks only."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for such rows: ``spark.checkpoint.dir``; where it is unset, a temp folder, on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="trendweave-checkpoint-")
            atexit.register(shutil.rmtree, own, True)
            folder = "file://" + own
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df as they were computed once; partitions and the order within them stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
