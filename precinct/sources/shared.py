"""The folder all executors can reach, for checkpoints and intermediate files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Application -> (folder the session named, checkpoint folder Spark made in it).
_named: dict[str, tuple[str, str]] = {}


def _is_local(master: str) -> bool:
    """One process; ``local-cluster[...]`` has executors with folders of their own."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``, and whatever folder was set before
    gives way to it. Where neither that nor a checkpoint folder is set, local mode makes a
    folder of its own and removes it at exit; a real cluster gets an error, because a
    folder on one machine would be lost with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if folder:
        if current is None or _named.get(context.applicationId) != (folder, current):
            context.setCheckpointDir(folder)
            _named[context.applicationId] = (folder, context.getCheckpointDir())
    elif current is None:
        if not _is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="precinct-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Return a new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this session wrote to its checkpoint folder; call it before the end.

    Tables and DataFrames that read from there no longer work afterwards.
    """
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the Parquet copy.

    What follows depends on the copy alone: it survives lost executors, and rows keep the
    files and places they were written to.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
