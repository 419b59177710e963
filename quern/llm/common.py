"""Plumbing that the operators of this subpackage share: Arrow row maps, shared storage, size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a table is broadcast; above it, every caller shuffles.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch.
BATCH = 1000


def col(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local session takes a temporary folder; a cluster is refused, as its parts would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def gone():
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended before
            pass

    atexit.register(gone)
    return path


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing lazy reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are done deleted: Spark does so when the driver's JVM collects their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, index: int, budget: int):
    """Cut a batch so that column ``index`` holds about ``budget`` bytes in each part; one row may exceed it."""
    column = batch.column(index)
    if not batch.num_rows:
        return
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        yield batch
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + budget, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession) -> None:
    """Texts are long: unless the session says otherwise, Arrow batches hold BATCH rows, not Spark's 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def tidy() -> None:
    """Give memory that a worker's task no longer needs back to the system: workers stay for the tasks to come."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidied(run):
    """The task function, giving memory back before and after each task."""

    def task(batches):
        tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return task


def arrow_map(df: DataFrame, inputs: list[str], outputs: str | T.StructType, factory, keep: list[str] | None = None, budget: int = 2_000_000) -> DataFrame:
    """Add columns that ``factory()(*input arrays) -> list of arrays`` makes, batch by batch, with no shuffle.

    ``keep``: columns that pass through (all, if None). An output replaces a kept column of its name.
    The function sees parts of at most ``budget`` bytes of the first input, or one row.
    """
    small_batches(df.sparkSession)
    added = T._parse_datatype_string(outputs) if isinstance(outputs, str) else outputs
    names = set(added.names)
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    picked = kept + [c for c in dict.fromkeys(inputs) if c not in kept]
    at = [picked.index(c) for c in inputs]
    count = len(kept)
    schema = T.StructType([df.schema[c] for c in kept] + list(added.fields))
    titles = schema.names

    def run(batches):
        work = factory()
        for batch in batches:
            for part in slices(batch, at[0], budget):
                made = work(*[part.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(count)] + list(made), names=titles)

    return df.select(*[col(c) for c in picked]).mapInArrow(tidied(run), schema)


def join_small(left: DataFrame, right: DataFrame, on: str, how: str = "left", salts: int = 32) -> DataFrame:
    """Join to a table with one row per key: broadcast if it is counted to be at most BROADCAST_ROWS rows.

    Above that, both sides shuffle on (key, salt), the right one repeated for each salt, so that a hot key of
    the left side is dealt over ``salts`` tasks. ``right`` should be written or otherwise cheap to count.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    salted = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.withColumn("__salt", (F.monotonically_increasing_id() % salts).cast("int")).join(salted, [on, "__salt"], how).drop("__salt")
