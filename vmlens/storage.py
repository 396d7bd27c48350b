"""Folders that the driver and all executors see, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors see. Only a session of one machine may do without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vmlens-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute `df` once and keep it in the shared checkpoint folder: lineage is cut and lost executors cost nothing.

    The files are removed as the session says (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, removed when the driver ends if it's still there then."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    files, path = _file_system(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """`df` written as Parquet in the shared folder: like durable(), but compressed, and later reads take only their columns."""
    folder = f"{new_folder(df.sparkSession, name)}/table"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
