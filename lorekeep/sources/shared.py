"""The shared folder for tables that one job writes and a later job reads.

Cutting lineage goes through written tables in this folder (or through
``checkpoint()``, which uses the same one), so that a lost executor costs the
re-reading of a file and not the recomputation of a job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder; one of our own only for a local, unset session."""
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/lorekeep/{name}-{uuid.uuid4().hex}"
