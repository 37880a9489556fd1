"""Shared pieces: table access, lineage cuts in the shared folder, worker import path."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Word rule shared by the contracts: maximal runs of anything but space and \x09-\x0D.
WORD_BREAKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver had it on its path, and keep the batches
    that go to them small, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in have if p]])


def give_back() -> None:
    """In a Python worker, which outlives its task: unused memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder in local mode,
    whose executors are the driver; on a cluster that would be another disk for each, so it raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(where[7:], exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_stored: dict[str, SparkSession] = {}


@atexit.register
def _clean_up() -> None:
    """Delete this process's tables in the shared folder, while a session is there to do it."""
    for path, spark in list(_stored.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    _stored.pop(path, None)


def materialize(df: DataFrame, label: str, parts: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so later stages do not depend on
    executors staying alive. The result carries its path in ``_stored_at`` for release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if parts:
        writer = writer.partitionBy(parts)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _stored[path] = spark
    return out


def release(df: DataFrame) -> None:
    """Delete a table written by materialize() once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


def stored() -> set[str]:
    """Paths of the tables that materialize() has written and nobody has released."""
    return set(_stored)


def forget(paths: set[str]) -> None:
    """Delete these tables."""
    for p in paths & set(_stored):
        _delete(_stored[p], p)


def crc_mod(id_col: str, mod: int):
    """crc32 of the id written as text, modulo mod."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as it takes to differ from df's columns in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def few(df: DataFrame, limit: int) -> DataFrame:
    """df (a stored table), marked for broadcast if it has at most limit rows; beyond that a join shuffles it."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of edges (a, b): node and comp, the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label of that label; labels are
    written to the shared folder after every round. Only minima are gathered per node, so hubs are harmless."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"{label}-edges")
    lab = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), f"{label}-labels")
    while True:
        near = both.join(lab, both["v"] == lab["node"]).groupBy("u").agg(F.min("comp").alias("m"))
        step = lab.join(near, lab["node"] == near["u"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        top = lab.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = materialize(step.join(top, "comp").select("node", "old", F.least("comp", "top").alias("comp")), f"{label}-labels")
        release(lab)
        lab = new
        if not new.filter("old <> comp").limit(1).count():
            release(both)
            out = new.select("node", "comp")
            out._stored_at = new._stored_at
            return out
