"""Folders for tables that are written and read again, in space that the driver and all executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path below `spark.checkpoint.dir`; below a local folder only where that is unset and all tasks run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/assayer/{tag}-{uuid.uuid4().hex}"
