"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a local session takes a temporary folder, and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise QueryError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path in any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def gone():
        try:
            fs, where = filesystem(spark, path)
            fs.delete(where, True)
        except Exception:  # the session has ended before
            pass

    atexit.register(gone)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back; the files go when the driver ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing lazy reads any more, and have the JVM find shuffle files that are done with."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, where = filesystem(df.sparkSession, path)
            fs.delete(where, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()
