"""Cutting lineage by writing tables to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a fresh local folder only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    The table outlives lost executors and is computed once, unlike a checkpoint, which runs its plan twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
