"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. Without the setting, a temporary folder in local mode, and an
    error on a cluster."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tapeline-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder; what follows survives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """A new folder's name below the shared one."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"
