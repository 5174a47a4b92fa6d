"""Folders for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``.

    Where that is unset, local sessions get a temporary folder and clusters an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spendlens-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
