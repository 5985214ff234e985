"""Tables that a job writes down for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where none is set, a local session gets one of its own; on a cluster no folder of this machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mosaikon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs one stage and not the whole job, and it gives later
    joins a plain scan on this side, which adaptive execution may split when a key is hot.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete tables of scratch() that nothing reads any more."""
    for df in tables:
        fs, at = _file(df.sparkSession, df.scratch_path)
        fs.delete(at, True)
