"""A folder that driver and executors share, for what a query writes and reads back."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, tempfile.TemporaryDirectory] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder stands for it only where all run on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.TemporaryDirectory(prefix="scratch-")
            atexit.register(_own["dir"].cleanup)
        told = f"file://{_own['dir'].name}"
    return f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: its lineage ends there, and any executor can read it again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
