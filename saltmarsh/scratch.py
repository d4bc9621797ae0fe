"""Run folders for intermediate tables.

Intermediate tables go below the folder the cluster names in
``spark.checkpoint.dir``, so that every executor sees them and a lost executor
costs nothing. Only a local master may fall back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"
_local_base: str | None = None
_made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    global _local_base
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="saltmarsh-")
    return _local_base


def run_folder(spark: SparkSession, label: str) -> str:
    """A path that no other run uses, below the shared folder."""
    path = f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete_run_folders(spark: SparkSession) -> int:
    """Delete the folders this process has made so far, once no result that reads them is needed; how many there were."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    deleted = 0
    while _made:
        path = hadoop.Path(_made.pop())
        deleted += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return deleted
