"""Reading and writing tables, sets and tensors as Parquet, JSON or CSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.btree import OrderedSet
from ..operators.table import Table
from ..operators.tensor import Tensor
from ..schema import Column, TableSchema, TensorSchema
from .storage import filesystem

SCHEMA = "_quern_schema.json"


def read_table(spark: SparkSession, path: str, schema: TableSchema, fmt: str = "parquet", unique: bool = True) -> Table:
    """Only the declared columns are scanned."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(schema.struct()).option("header", "true")
    return Table.copy_from(schema, reader.load(path), unique)


def read_set(spark: SparkSession, path: str, columns, fmt: str = "parquet") -> OrderedSet:
    return OrderedSet.copy_from(columns, spark.read.format(fmt).load(path))


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = filesystem(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def _get_text(spark: SparkSession, path: str) -> str:
    fs, where = filesystem(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def save(obj: Table | OrderedSet | Tensor, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """The rows (range-partitioned by key, so that key ranges prune files) with the schema beside them."""
    spark = obj.df.sparkSession
    if isinstance(obj, Tensor):
        keys, about = obj.coords, {"kind": "tensor", "dtype": obj.dtype, "shape": obj.shape, "sparse": obj.sparse}
    else:
        keys = obj.names if isinstance(obj, OrderedSet) else obj.schema.key_names
        column = lambda c: [c.name, c.dtype, c.max_len]
        about = {"kind": "set" if isinstance(obj, OrderedSet) else "table", "key": [column(c) for c in obj.schema.key], "values": [column(c) for c in obj.schema.values], "indices": {n: list(c) for n, c in obj.schema.indices}}
    df = obj.df
    if keys:
        df = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    writer = df.write.format(fmt).mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    _put_text(spark, f"{path}/{SCHEMA}", json.dumps(about))


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> Table | OrderedSet | Tensor:
    about = json.loads(_get_text(spark, f"{path}/{SCHEMA}"))
    if about["kind"] == "tensor":
        return Tensor(spark.read.format(fmt).load(path), TensorSchema(about["dtype"], tuple(about["shape"])), about["sparse"])
    schema = TableSchema(tuple(Column(*c) for c in about["key"]), tuple(Column(*c) for c in about["values"]), tuple((n, tuple(c)) for n, c in about["indices"].items()))
    df = spark.read.format(fmt).load(path).select(*schema.names)
    return OrderedSet(df, schema.key) if about["kind"] == "set" else Table(df, schema)


def rows_json(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Each row as a JSON array in the schema's order: the wire form of a view."""
    return df.select(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("null")) for c in schema.names])).alias("row"))
