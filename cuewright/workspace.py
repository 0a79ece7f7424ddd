"""A working folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only local mode, where driver and tasks are one process, has one of its own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/cuewright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
