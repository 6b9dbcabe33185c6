"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a folder of this machine in local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "corpusmill-scratch")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
