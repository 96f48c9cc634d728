"""What every query needs from the session: importable workers and a shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of the batches that Spark hands to Python workers: whole texts travel in them, and a task holds two on
#: either side. A setting of the session's own stays.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this host import the package; on a cluster it is shipped with --py-files. Where the session
    has Spark's own sizes of Arrow batches, smaller ones are set."""
    for name, (default, smaller) in _BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, smaller)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='vecspark-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_made: dict[str, SparkSession] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, until release()."""
    path = f"{shared_dir(spark)}/vecspark/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made[path] = spark
    return path


def drop(path: str) -> None:
    """Deletes what was written to a path of fresh_path()."""
    spark = _made.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Deletes what fresh_path() and stored() have led to; frames that still read it are of no use afterwards. It is
    called when the program ends, and can be called before."""
    while _made:
        path, spark = _made.popitem()
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df written as a table in the shared folder, and read from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
