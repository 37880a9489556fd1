"""Folders that the driver and all executors share, and the import path of Python workers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, cleared when the process ends. Where that is unset, a temporary folder
    in local mode, whose executors are the driver; on a cluster each would have another disk, so it raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/lexforge"
    path = f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _made.pop(path, None)


@atexit.register
def _clear() -> None:
    for path, spark in list(_made.items()):
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver has it on its path."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
