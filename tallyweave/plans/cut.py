"""Cutting lineage: reliable checkpoints, or compressed tables, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; in local mode, one of ours where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    root = tempfile.mkdtemp(prefix="tallyweave-cut-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed below spark.checkpoint.dir; where that is unset, below a folder of ours in local mode."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


def packed(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, removed when the interpreter ends.

    For wide frames: the files are compressed, those of a checkpoint are not.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/packed-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
