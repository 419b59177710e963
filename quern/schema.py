"""Declared schemas: columns, tables, tensors; validation as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QueryError

COMPLEX64 = T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())])
COMPLEX128 = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
VERSION = T.StructType([T.StructField(n, T.LongType()) for n in ("major", "minor", "rev")])

# Logical types in their order of promotion, each with the Spark type that holds all its values.
NUMBERS: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(), "c32": COMPLEX64, "c64": COMPLEX128,
}
ABSTRACT = {"uint": "u64", "int": "i64", "float": "f64", "complex": "c64", "number": "f64"}
SIZED: dict[str, T.DataType] = {"string": T.StringType(), "bytes": T.BinaryType(), "id": T.StringType(), "link": T.StringType(), "email": T.StringType(), "version": VERSION, "tuple": T.ArrayType(T.StringType())}
LIMITS = {"u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1)}
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LINK = r"^(/|[a-zA-Z][a-zA-Z0-9+.-]*:).*"
NAME = r"^[^\s/$]+$"


def concrete(dtype: str) -> str:
    dtype = ABSTRACT.get(dtype, dtype)
    if dtype not in NUMBERS and dtype not in SIZED:
        raise QueryError(f"unknown type {dtype}")
    return dtype


def spark_type(dtype: str) -> T.DataType:
    dtype = concrete(dtype)
    return NUMBERS.get(dtype) or SIZED[dtype]


def bounds(dtype: str) -> tuple[int, int]:
    """The least and the greatest value of an integer type; unsigned ones are held in the next wider signed type."""
    kind = concrete(dtype)
    if kind[0] not in "iu" or not kind[1:].isdigit():
        raise QueryError(f"{dtype} has no bounds")
    n = int(kind[1:])
    return (0, (1 << n) - 1) if kind[0] == "u" else (-(1 << n - 1), (1 << n - 1) - 1)


def promote(*dtypes: str) -> str:
    """The type of an operation on mixed operands: the later in the order of promotion."""
    order = list(NUMBERS)
    return max((concrete(d) for d in dtypes), key=order.index)


@dataclass(frozen=True)
class Column:
    name: str
    dtype: str
    max_len: int | None = None

    def __post_init__(self):
        if (concrete(self.dtype) in NUMBERS) == (self.max_len is not None):
            raise QueryError(f"{self.name}: numbers take no maximum length, other types need one")

    def field(self, key: bool = False) -> T.StructField:
        return T.StructField(self.name, spark_type(self.dtype), True, {"logical_type": concrete(self.dtype), "max_len": self.max_len or 0, "key": key})

    def checked(self, value: Expr) -> Expr:
        """The value cast to this column's type; a task fails on one that does not fit."""
        dtype = concrete(self.dtype)
        value = value.cast(spark_type(dtype))

        def fail(why: str) -> Expr:
            return F.raise_error(F.lit(f"invalid value for column {self.name}: {why}")).cast(spark_type(dtype))

        if dtype in LIMITS:
            low, high = LIMITS[dtype]
            return F.when((value < F.lit(low)) | (value > F.lit(high).cast("decimal(20,0)")), fail("out of range")).otherwise(value)
        if self.max_len is not None and dtype in ("string", "bytes", "id", "link", "email"):
            value = F.when(F.length(value) > self.max_len, fail("too long")).otherwise(value)
            pattern = {"email": EMAIL, "link": LINK, "id": NAME}.get(dtype)
            if pattern:
                value = F.when(~value.rlike(pattern), fail(f"not {dtype}")).otherwise(value)
        return value


@dataclass(frozen=True)
class TableSchema:
    """Key columns, value columns and named indices; an index's columns are followed by the key's."""

    key: tuple[Column, ...]
    values: tuple[Column, ...] = ()
    indices: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @staticmethod
    def of(key, values=(), indices=None) -> TableSchema:
        make = lambda c: c if isinstance(c, Column) else Column(*c)
        return TableSchema(tuple(map(make, key)), tuple(map(make, values)), tuple((n, tuple(c)) for n, c in (indices or {}).items()))

    def __post_init__(self):
        names = self.names
        if len(set(names)) != len(names):
            raise QueryError("column names repeat")
        for name, columns in self.indices:
            if missing := [c for c in columns if c not in names]:
                raise QueryError(f"index {name} names unknown columns {missing}")

    @property
    def columns(self) -> tuple[Column, ...]:
        return self.key + self.values

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key_names(self) -> list[str]:
        return [c.name for c in self.key]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise QueryError(f"unknown column {name}")

    def create_index(self, name: str, columns: list[str]) -> TableSchema:
        return TableSchema(self.key, self.values, (*self.indices, (name, tuple(columns))))

    def struct(self) -> T.StructType:
        return T.StructType([c.field(c in self.key) for c in self.columns])

    def validate(self, df: DataFrame) -> DataFrame:
        """Columns by name, cast and checked lazily; missing and unknown columns are errors now."""
        if set(df.columns) != set(self.names):
            raise QueryError(f"columns {df.columns} do not match {self.names}")
        return df.select(*[c.checked(F.col(c.name)).alias(c.name, metadata=c.field(c in self.key).metadata) for c in self.columns])

    def orders(self) -> list[list[str]]:
        """Column orders in which the table can be scanned: the key's, and each index's."""
        return [self.key_names, *[[*c, *[k for k in self.key_names if k not in c]] for _, c in self.indices]]

    def supports(self, columns: list[str]) -> bool:
        """Whether some order begins with these columns, in any order among themselves."""
        return any(set(o[: len(columns)]) == set(columns) for o in self.orders())

    def selected(self, names: list[str]) -> TableSchema:
        if len(set(names)) != len(names):
            raise QueryError("a column is selected twice")
        return TableSchema((), tuple(self.column(n) for n in names))


@dataclass(frozen=True)
class TensorSchema:
    dtype: str
    shape: tuple[int, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "dtype", concrete(self.dtype))
        if self.dtype not in NUMBERS:
            raise QueryError(f"a tensor holds numbers, not {self.dtype}")
        if not self.shape or any(d < 1 or d > 2**32 - 1 for d in self.shape) or self.size > 2**64:
            raise QueryError(f"invalid shape {self.shape}")

    @property
    def size(self) -> int:
        return reduce(lambda a, b: a * b, self.shape, 1)

    @property
    def ndim(self) -> int:
        return len(self.shape)
