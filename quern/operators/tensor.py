"""n-dimensional arrays as coordinate tables: BIGINT columns x0, x1, ... and a value v.

A dense tensor has a row for every coordinate, a sparse one for every non-zero. All operations are lazy and
stay in Catalyst: element-wise maps are projections; binary operations are equi-joins on the axes that both
operands have (axes that one of them stretches are not in the key, so nothing is repeated before the join);
reductions are aggregations with map-side partials. ``matmul`` and ``einsum`` join on shared labels and add up;
``matmul(blocks=)`` packs dense operands to numpy blocks first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, Unsupported
from ..functions import number as N
from ..ranges import axes as parse_axes
from ..schema import TensorSchema, promote, spark_type
from ..sources.storage import written
from . import shape as S
from .table import placed

FLOATS = ("f32", "f64")


#: Rows of a coordinate join beyond which a dense product takes numpy blocks, and their edge.
JOINED = 50_000_000
EDGE = 256
#: Repeats of a row that are made in one go, and rows up to which a tensor is sent to those of a longer axis.
STRETCH = 1 << 16
#: Cells of a block in which a sparse tensor's zeros are filled in, and rows of one at most where it has many columns.
GAP, TALL = 1 << 16, 256


def _uniform(i: Column, seed: int) -> Column:
    """In [0, 1), from 52 bits of the MD5 of seed:coordinate; any SQL engine can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), i.cast("string"))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _normal(i: Column, seed: int) -> Column:
    """By Box and Muller."""
    u = F.lit(1.0) - _uniform(i, 2 * seed + 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * np.pi) * _uniform(i, 2 * seed + 2))


def x(i: int) -> str:
    return f"x{i}"


def xs(n: int) -> list[str]:
    return [x(i) for i in range(n)]


def repeated(df: DataFrame, axis: str, n: int) -> DataFrame:
    """Every row at each place 0 to n - 1 of an axis, at most ``STRETCH`` places of it in memory."""
    if n <= STRETCH:
        return df.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    df = df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // STRETCH).cast("long"))) * STRETCH)
    return df.withColumn(axis, F.explode(F.sequence("__part", F.least(F.col("__part") + STRETCH, F.lit(n).cast("long")) - 1))).drop("__part")


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    schema: TensorSchema
    sparse: bool = False
    #: Rows (x0, array of doubles) that hold the same cells, where these were read off arrays and not changed since.
    arrays: DataFrame | None = None

    # -- constructors

    @staticmethod
    def _grid(spark: SparkSession, shape: S.Shape) -> DataFrame:
        steps = S.strides(shape)
        return spark.range(S.size(shape)).select("id", *[F.expr(f"(id DIV {step}) % {dim}").cast("long").alias(x(i)) for i, (dim, step) in enumerate(zip(shape, steps))])

    @staticmethod
    def _made(spark, dtype: str, shape: S.Shape, value: Callable[[Column], Column]) -> Tensor:
        schema = TensorSchema(dtype, tuple(shape))
        return Tensor(Tensor._grid(spark, schema.shape).select(*xs(schema.ndim), value(F.col("id")).cast(spark_type(dtype)).alias("v")), schema)

    @staticmethod
    def constant(spark, shape: S.Shape, value, dtype: str = "f64") -> Tensor:
        return Tensor._made(spark, dtype, shape, lambda i: F.lit(value))

    @staticmethod
    def zeros(spark, shape: S.Shape, dtype: str = "f64", sparse: bool = False) -> Tensor:
        if sparse:
            schema = TensorSchema(dtype, tuple(shape))
            fields = [T.StructField(n, T.LongType()) for n in xs(len(shape))] + [T.StructField("v", spark_type(dtype))]
            return Tensor(spark.createDataFrame([], T.StructType(fields)), schema, True)
        return Tensor.constant(spark, shape, 0, dtype)

    @staticmethod
    def ones(spark, shape: S.Shape, dtype: str = "f64") -> Tensor:
        return Tensor.constant(spark, shape, 1, dtype)

    def zeros_like(self) -> Tensor:
        return Tensor.zeros(self.df.sparkSession, self.shape, self.dtype, self.sparse)

    def ones_like(self) -> Tensor:
        return Tensor.ones(self.df.sparkSession, self.shape, self.dtype)

    @staticmethod
    def arange(spark, shape: S.Shape, start, stop) -> Tensor:
        """Evenly spaced from start, stop excluded; integers if both ends are and the step is whole."""
        n = S.size(tuple(shape))
        whole = isinstance(start, int) and isinstance(stop, int) and (stop - start) % n == 0
        if whole:
            return Tensor._made(spark, "i64", shape, lambda i: i * ((stop - start) // n) + start)
        return Tensor._made(spark, "f64", shape, lambda i: i * ((stop - start) / n) + float(start))

    @staticmethod
    def random_uniform(spark, shape: S.Shape, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Tensor:
        """The draw depends on (seed, coordinate) alone, so a recomputed partition repeats it."""
        return Tensor._made(spark, "f64", shape, lambda i: _uniform(i, seed) * (high - low) + low)

    @staticmethod
    def random_normal(spark, shape: S.Shape, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> Tensor:
        return Tensor._made(spark, "f64", shape, lambda i: _normal(i, seed) * std + mean)

    @staticmethod
    def truncated_normal(spark, shape: S.Shape, mean: float = 0.0, std: float = 1.0, low: float | None = None, high: float | None = None, seed: int = 0) -> Tensor:
        """The inverse of the normal distribution between the bounds, by bisection on its error function."""
        from math import erf, sqrt

        low, high = mean - 2 * std if low is None else low, mean + 2 * std if high is None else high
        if not low < high:
            raise QueryError("empty interval")
        cdf = lambda z: 0.5 * (1 + erf((z - mean) / (std * sqrt(2))))
        a, b = cdf(low), cdf(high)

        @F.pandas_udf("double")
        def inverse(u: pd.Series) -> pd.Series:
            p, lo, hi = a + (b - a) * u.to_numpy(), np.full(len(u), low), np.full(len(u), high)
            f = np.vectorize(cdf, otypes=[float])
            for _ in range(52):
                mid = (lo + hi) / 2
                up = f(mid) < p
                lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
            return pd.Series((lo + hi) / 2)

        return Tensor._made(spark, "f64", shape, lambda i: inverse(_uniform(i, seed)))

    @staticmethod
    def eye(spark, n: int, dtype: str = "bool") -> Tensor:
        return Tensor(spark.range(n).select(F.col("id").alias("x0"), F.col("id").alias("x1"), F.lit(1).cast(spark_type(dtype)).alias("v")), TensorSchema(dtype, (n, n)), True)

    @staticmethod
    def load(spark, shape: S.Shape, elements: list, dtype: str | None = None, sparse: bool | None = None) -> Tensor:
        """From [n, ...] (dense) or [(coordinate, n), ...] (sparse); the type of the first element, if none is given."""
        pairs = bool(elements) and isinstance(elements[0], tuple) and isinstance(elements[0][0], (tuple, list))
        first = (elements[0][1] if pairs else elements[0]) if elements else 0.0
        dtype = dtype or ("bool" if isinstance(first, bool) else "i64" if isinstance(first, int) else "c64" if isinstance(first, complex) else "f64")
        schema = TensorSchema(dtype, tuple(shape))
        cast = (lambda v: (float(v.real), float(v.imag))) if dtype[0] == "c" else float if dtype in FLOATS else bool if dtype == "bool" else int
        if pairs:
            rows = [(*map(int, at), cast(v)) for at, v in elements]
            if any(not 0 <= c < d for r in rows for c, d in zip(r, schema.shape)):
                raise QueryError("a coordinate is out of bounds")
        else:
            if len(elements) != schema.size:
                raise QueryError(f"{len(elements)} elements for a shape of {schema.size}")
            rows = [(*map(int, np.unravel_index(i, schema.shape)), cast(v)) for i, v in enumerate(elements)]
        fields = [T.StructField(n, T.LongType()) for n in xs(schema.ndim)] + [T.StructField("v", spark_type(dtype))]
        t = Tensor(spark.createDataFrame(rows, T.StructType(fields)), schema, pairs)
        return t if sparse is None or sparse == pairs else t.to_sparse() if sparse else t.to_dense()

    @staticmethod
    def from_frame(df: DataFrame, coords: list[str], value: str | Column, shape: S.Shape, dtype: str = "f64", sparse: bool = True) -> Tensor:
        """From a table with one row for each coordinate (sparse: zeros are left out)."""
        v = (F.col(value) if isinstance(value, str) else value).cast(spark_type(dtype))
        out = Tensor(df.select(*[F.col(c).cast("long").alias(x(i)) for i, c in enumerate(coords)], v.alias("v")), TensorSchema(dtype, tuple(shape)), sparse)
        return out._nonzero() if sparse else out

    @staticmethod
    def from_arrays(df: DataFrame, row: str, array: str, shape: S.Shape, dtype: str = "f64") -> Tensor:
        """A dense matrix from a table of (row number, array)."""
        out = df.select(F.col(row).cast("long").alias("x0"), F.posexplode(array).alias("p", "e"))
        kind = spark_type(dtype)
        arrays = None if dtype[0] == "c" else df.select(F.col(row).cast("long").alias("x0"), F.col(array).cast(T.ArrayType(kind)).cast("array<double>").alias("a"))
        return Tensor(out.select("x0", F.col("p").cast("long").alias("x1"), F.col("e").cast(kind).alias("v")), TensorSchema(dtype, tuple(shape)), arrays=arrays)

    # -- introspection

    @property
    def dtype(self) -> str:
        return self.schema.dtype

    @property
    def shape(self) -> S.Shape:
        return self.schema.shape

    @property
    def ndim(self) -> int:
        return self.schema.ndim

    @property
    def size(self) -> int:
        return self.schema.size

    @property
    def coords(self) -> list[str]:
        return xs(self.ndim)

    @property
    def _complex(self) -> bool:
        return self.dtype[0] == "c"

    def _like(self, df: DataFrame, dtype: str | None = None, shape: S.Shape | None = None, sparse: bool | None = None) -> Tensor:
        sparse = self.sparse if sparse is None else sparse
        out = Tensor(df, TensorSchema(dtype or self.dtype, tuple(shape or self.shape)), sparse)
        return out

    def _nonzero(self) -> Tensor:
        zero = (F.col("v.re") != 0) | (F.col("v.im") != 0) if self._complex else F.col("v").cast("double") != 0
        return self._like(self.df.where(zero))

    # -- reads

    def elements(self) -> DataFrame:
        """Rows in coordinate order (of a sparse tensor, the non-zero ones)."""
        return self.df.orderBy(*self.coords)

    def read(self, at: tuple[int, ...]):
        found = self.df.where(self._point(at)).select("v").limit(1).collect()
        return found[0][0] if found else False if self.dtype == "bool" else 0

    def _point(self, at: tuple[int, ...]) -> Column:
        if len(at) != self.ndim:
            raise QueryError("a point needs every coordinate")
        out = F.lit(True)
        for i, (c, d) in enumerate(zip(at, self.shape)):
            c = c + d if c < 0 else c
            if not 0 <= c < d:
                raise QueryError(f"{at} is out of bounds")
            out &= F.col(x(i)) == c
        return out

    def filled_at(self, axes) -> DataFrame:
        return self.df.select(*[x(i) for i in S.some_axes(axes, self.ndim)]).distinct()

    def copy(self) -> Tensor:
        """Materialised in the shared folder: later reads don't repeat this tensor's plan."""
        return self._like(written(self.df, "tensor"))

    def to_numpy(self) -> np.ndarray:
        """For small tensors: the only read that brings all elements to the driver."""
        kind = {"bool": bool, "f32": np.float32, "f64": np.float64, "c32": complex, "c64": complex}.get(self.dtype, np.int64)
        out = np.zeros(self.shape, kind)
        for r in self.df.collect():
            out[tuple(r[c] for c in self.coords)] = complex(*r["v"]) if self._complex else r["v"]
        return out

    # -- conversion

    def to_sparse(self) -> Tensor:
        return self if self.sparse else self._like(self.df, sparse=True)._nonzero()

    def to_dense(self) -> Tensor:
        if not self.sparse:
            return self
        spark, size, kind = self.df.sparkSession, self.size, spark_type(self.dtype)
        zero = (N.cx(0.0, 0.0) if self._complex else F.lit(0)).cast(kind)
        # blocks are tiles of rows (all axes but the last) and columns, and run down their columns: one coordinate stays for
        # long and the other is soon back, which a file's encodings need where an axis is longer than they see
        columns, steps = self.shape[-1], S.strides(self.shape[:-1])
        rows = size // columns
        tall = min(rows, max(TALL, GAP // columns))
        tall = -(-rows // -(-rows // tall))
        wide = min(columns, max(1, GAP // tall))
        across, bands = -(-columns // wide), -(-rows // tall)
        row, inside = F.lit(0).cast("long"), F.lit(True)
        for c, step in zip(self.coords, steps):
            row = row + F.col(c) * step
        for c, dim in zip(self.coords, self.shape):
            inside = inside & (F.col(c) >= 0) & (F.col(c) < dim)
        cells = self.df.where(inside).select(row.alias("r"), F.col(self.coords[-1]).alias("c"), F.coalesce("v", zero).cast(kind).alias("v"))
        cells = cells.select(F.expr(f"r DIV {tall} * {across} + c DIV {wide}").alias("b"), F.expr(f"c % {wide} * {tall} + r % {tall}").alias("o"), "v", F.lit(True).alias("cell"))
        starts = spark.range(bands * across).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("o"), zero.alias("v"), F.lit(False).alias("cell"))
        # only the cells and the blocks' starts are dealt out; each makes the zeros up to the next
        blocks = bands * across
        parts = int(max(min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), min(blocks, size // (GAP << 10))))
        dealt = cells.unionByName(starts).withColumn("part", F.expr(f"CAST(b DIV {-(-blocks // parts)} AS INT)")).repartitionById(parts, F.col("part"))
        end = F.least(F.lit(wide).cast("long"), columns - F.col("b") % across * wide) * tall
        runs = dealt.withColumn("next", F.coalesce(F.lead("o").over(Window.partitionBy("part", "b").orderBy("o", "cell")), end)).where(F.col("cell") | (F.col("next") > F.col("o")))
        at = runs.select(F.expr(f"b DIV {across} * {tall}").alias("r"), F.expr(f"b % {across} * {wide}").alias("c"), "o", "v", F.explode(F.sequence("o", F.greatest("o", F.col("next") - 1))).alias("at"))
        if bands * tall > rows:  # the last band is lower
            at = at.where(f"r + at % {tall} < {rows}")
        axes = [F.expr(f"(r + at % {tall}) DIV {step} % {dim}" if k else f"(r + at % {tall}) DIV {step}") for k, (step, dim) in enumerate(zip(steps, self.shape))] + [F.expr(f"c + at DIV {tall}")]
        return self._like(at.select(*[e.cast("long").alias(c) for e, c in zip(axes, self.coords)], F.when(F.col("at") == F.col("o"), F.col("v")).otherwise(zero).alias("v")), sparse=False)

    def cast(self, dtype: str) -> Tensor:
        v = F.col("v")
        if dtype[0] == "c" and not self._complex:
            v = N.cx(v)
        elif self._complex and dtype[0] != "c":
            v = v["re"]
        elif dtype == "bool":
            v = v.cast("double") != 0
        out = self._like(self.df.select(*self.coords, v.cast(spark_type(dtype)).alias("v")), dtype)
        return out._nonzero() if self.sparse else out

    # -- element-wise

    def unary(self, op: str) -> Tensor:
        if self.sparse and op == "not":
            raise Unsupported("the result of not is dense; convert first")
        if self._complex:
            if op not in N.C_UNARY:
                raise Unsupported(f"{op} of complex numbers")
            v = N.C_UNARY[op](F.col("v"))
            dtype = "f64" if op in ("abs", "angle", "real", "imag", "norm") else self.dtype
        else:
            v = N.UNARY[op](F.col("v"))
            dtype = "bool" if op == "not" else self.dtype if op in ("abs", "round", "neg", "real") else "f64"
        out = self._like(self.df.select(*self.coords, v.cast(spark_type(dtype)).alias("v")), dtype)
        return out._nonzero() if self.sparse else out

    def _result_type(self, op: str, other: str) -> str:
        if op in N.COMPARISONS or op in N.LOGICAL:
            return "bool"
        if op in ("div", "log", "pow") and "c" not in (self.dtype[0], other[0]):
            return "f64"
        return promote(self.dtype, other)

    def with_number(self, op: str, n) -> Tensor:
        other = "c64" if isinstance(n, complex) else "bool" if isinstance(n, bool) else "i64" if isinstance(n, int) else "f64"
        dtype = self._result_type(op, other)
        if isinstance(n, int) and not isinstance(n, bool) and not self._complex and op in ("add", "sub", "mul", "mod"):
            dtype = self.dtype  # a whole number takes the tensor's type
        if op in ("div", "mod") and n == 0:
            raise QueryError("division by zero")
        if self.sparse:
            zero = {"gt": 0 > n, "ge": 0 >= n, "lt": 0 < n, "le": 0 <= n, "eq": n == 0, "ne": True}.get(op) if not isinstance(n, complex) else True
            if op in ("add", "sub", "or", "xor") or op in N.COMPARISONS and zero or op == "pow" and n == 0:
                raise Unsupported(f"{op} of a sparse tensor and {n} is dense; convert first")
        if self._complex or isinstance(n, complex):
            v = F.col("v") if self._complex else N.cx(F.col("v"))
            if op == "pow" and not isinstance(n, complex):
                v = N.c_pow(v, n)
            elif op in N.C_BINARY:
                n = complex(n)
                v = N.C_BINARY[op](v, N.cx(n.real, n.imag))
            else:
                raise Unsupported(f"{op} of complex numbers")
        else:
            v = N.BINARY[op](F.col("v"), n)
        out = self._like(self.df.select(*self.coords, v.cast(spark_type(dtype)).alias("v")), dtype)
        return out._nonzero() if self.sparse else out

    def of_number(self, op: str, n: float) -> Tensor:
        """``n op self`` for each element, n a double."""
        if self.sparse or self._complex:
            return Tensor.constant(self.df.sparkSession, (1,), n).binary(op, self)
        l, r, dtype = F.lit(n), F.col("v"), "bool" if op in N.COMPARISONS or op in N.LOGICAL else "f64" if op in ("div", "log", "pow") else promote("f64", self.dtype)
        if dtype != "bool":
            l, r = l.cast(spark_type(dtype)), r.cast(spark_type(dtype))
        return self._like(self.df.select(*self.coords, N.BINARY[op](l, r).cast(spark_type(dtype)).alias("v")), dtype)

    def _pair(self, other: Tensor, how: str) -> tuple[DataFrame, S.Shape]:
        """Rows (coordinates, l, r) of two tensors broadcast to one shape, joined on the axes that both have."""
        shape = S.broadcast(self.shape, other.shape)
        n = len(shape)
        dims = [(1,) * (n - t.ndim) + t.shape for t in (self, other)]
        a, b = self.expand_to(n), other.expand_to(n)
        shared = [i for i in range(n) if dims[0][i] == dims[1][i]]
        single = None
        if how != "inner" or not any(shape[i] > 1 for i in shared):
            # both must stand at every coordinate, or nothing is there to join on
            single = None if how != "inner" else "b" if not b.sparse and b.size == 1 else "a" if not a.sparse and a.size == 1 else None  # a single row, met by all
            a = a if single == "a" else a.broadcast(shape)
            b = b.broadcast(shape) if how == "full" or not single and not any(d > 1 and d == shape[i] for i, d in enumerate(b.shape)) else b
            shared = [i for i in range(n) if b.shape[i] == shape[i] and not single]
            dims = [a.shape, b.shape]
        left = a.df.select(*[F.col(x(i)).alias(f"l{i}") for i in range(n)], F.col("v").alias("l"))
        right = b.df.select(*[F.col(x(i)).alias(f"r{i}") for i in range(n)], F.col("v").alias("r"))
        on = [F.col(f"l{i}") == F.col(f"r{i}") for i in shared]
        at = [F.coalesce(f"l{i}", f"r{i}") if how == "full" and i in shared else F.col(f"l{i}") if dims[0][i] == shape[i] else F.col(f"r{i}") for i in range(n)]
        if on:
            both = left.join(right, on, "full_outer" if how == "full" else how)
        else:
            both = right.crossJoin(F.broadcast(left)) if single == "a" else left.crossJoin(F.broadcast(right))
        return both.select(*[c.alias(x(i)) for i, c in enumerate(at)], "l", "r"), shape

    def expand_to(self, ndim: int) -> Tensor:
        lead = ndim - self.ndim
        if not lead:
            return self
        df = self.df.select(*[F.lit(0).cast("long").alias(x(i)) for i in range(lead)], *[F.col(x(i)).alias(x(i + lead)) for i in range(self.ndim)], "v")
        return self._like(df, shape=(1,) * lead + self.shape)

    def binary(self, op: str, other) -> Tensor:
        if not isinstance(other, Tensor):
            return self.with_number(op, other)
        dtype = self._result_type(op, other.dtype)
        if self.sparse and other.sparse:
            if op in ("eq", "ge", "le"):
                raise Unsupported(f"{op} of sparse tensors is dense; convert one first")
            if op in ("div", "log", "pow", "mod"):
                raise Unsupported(f"the right side of {op} must be dense")
            sparse, how = True, "inner" if op in ("mul", "and") else "full"
        elif self.sparse:
            if op in ("mul", "div", "log", "pow", "mod", "and"):
                sparse, how = True, "inner"
            else:
                return self.to_dense().binary(op, other)
        elif other.sparse:
            if op in ("div", "log", "mod"):
                raise Unsupported(f"the right side of {op} must be dense")
            if op in ("mul", "and"):
                sparse, how = True, "inner"
            else:
                return self.binary(op, other.to_dense())
        else:
            sparse, how = False, "inner"
        df, shape = self._pair(other, how)
        l, r = F.col("l"), F.col("r")
        if self._complex or other._complex:
            if op not in N.C_BINARY:
                raise Unsupported(f"{op} of complex numbers")
            l, r = l if self._complex else N.cx(l), r if other._complex else N.cx(r)
            if how == "full":
                l, r = F.coalesce(l, N.cx(0.0)), F.coalesce(r, N.cx(0.0))
            v = N.C_BINARY[op](l, r)
        else:
            if how == "full":
                l, r = F.coalesce(l, F.lit(0).cast(spark_type(self.dtype))), F.coalesce(r, F.lit(0).cast(spark_type(other.dtype)))
            if op not in N.LOGICAL and dtype != "bool":
                l, r = l.cast(spark_type(dtype)), r.cast(spark_type(dtype))
            v = N.BINARY[op](l, r)
        out = Tensor(df.select(*xs(len(shape)), v.cast(spark_type(dtype)).alias("v")), TensorSchema(dtype, shape), sparse)
        return out._nonzero() if sparse else out

    __add__ = lambda a, b: a.binary("add", b)
    __sub__ = lambda a, b: a.binary("sub", b)
    __mul__ = lambda a, b: a.binary("mul", b)
    __truediv__ = lambda a, b: a.binary("div", b)
    __pow__ = lambda a, b: a.binary("pow", b)
    __mod__ = lambda a, b: a.binary("mod", b)
    __matmul__ = lambda a, b: a.matmul(b)
    __neg__ = lambda a: a.unary("neg")
    __and__ = lambda a, b: a.binary("and", b)
    __or__ = lambda a, b: a.binary("or", b)
    __xor__ = lambda a, b: a.binary("xor", b)

    def log(self, base=None) -> Tensor:
        return self.unary("ln") if base is None else self.binary("log", base)

    def cond(self, then, or_else) -> Tensor:
        """Where this is true the one, else the other, both broadcast; numbers are literals, tensors join on the axes they share."""
        values = (then, or_else)
        dtype = promote(*[t.dtype if isinstance(t, Tensor) else "f64" if isinstance(t, float) else "i64" for t in values])
        kind, both = spark_type(dtype), self.to_dense()
        both = both._like(both.df.select(*both.coords, F.struct(F.col("v").alias("c")).alias("v")))
        for k, t in enumerate(values):
            if isinstance(t, Tensor):
                df, shape = both._pair(t.to_dense(), "inner")
                both = both._like(df.select(*xs(len(shape)), F.struct("l.*", F.col("r").alias(f"t{k}")).alias("v")), shape=shape)
        a, b = [(F.col(f"v.t{k}") if isinstance(t, Tensor) else F.lit(t)).cast(kind) for k, t in enumerate(values)]
        out = Tensor(both.df.select(*both.coords, F.when(N.truth(F.col("v.c")), a).otherwise(b).alias("v")), TensorSchema(dtype, both.shape))
        return out.to_sparse() if all(isinstance(t, Tensor) and t.sparse for t in values) else out

    # -- reductions

    def _reduced(self, axes, keepdims: bool, dtype: str, agg: Column, sparse: bool | None = None) -> Tensor | DataFrame:
        axes = S.some_axes(axes, self.ndim)
        rest = [i for i in range(self.ndim) if i not in axes]
        agg = agg.cast(spark_type(dtype))
        if not rest and not keepdims:
            return self.df.agg(agg.alias("v"))
        if not rest:
            return Tensor(self.df.agg(agg.alias("v")).select(*[F.lit(0).cast("long").alias(n) for n in self.coords], "v"), TensorSchema(dtype, (1,) * self.ndim), False)
        df = self.df.groupBy(*[x(i) for i in rest]).agg(agg.alias("v"))
        if keepdims:
            cols = [F.col(x(i)) if i in rest else F.lit(0).cast("long").alias(x(i)) for i in range(self.ndim)]
            shape = tuple(1 if i in axes else d for i, d in enumerate(self.shape))
        else:
            cols = [F.col(x(i)).alias(x(k)) for k, i in enumerate(rest)]
            shape = tuple(self.shape[i] for i in rest)
        out = Tensor(df.select(*cols, "v"), TensorSchema(dtype, shape), self.sparse)
        return out._nonzero() if self.sparse else out

    def _real(self, what: str) -> None:
        if self._complex:
            raise Unsupported(f"{what} of complex numbers")

    def _count(self, axes) -> int:
        return S.size(tuple(self.shape[i] for i in S.some_axes(axes, self.ndim)))

    def _number(self) -> Column:
        return F.col("v").cast("long") if self.dtype == "bool" else F.col("v")

    def sum(self, axes=None, keepdims: bool = False):
        self._real("sum")
        dtype = self.dtype if self.dtype in FLOATS else "i64"
        return self._reduced(axes, keepdims, dtype, F.coalesce(F.sum(self._number()), F.lit(0)))

    def product(self, axes=None, keepdims: bool = False):
        self._real("product")
        p = F.product(self._number().cast("double"))
        if self.sparse:
            p = F.when(F.count("*") == self._count(axes), p).otherwise(F.lit(0.0))
        return self._reduced(axes, keepdims, "f64", p)

    def max(self, axes=None, keepdims: bool = False):
        """Of a sparse tensor, over the filled coordinates only."""
        self._real("max")
        return self._reduced(axes, keepdims, self.dtype, F.max("v"))

    def min(self, axes=None, keepdims: bool = False):
        self._real("min")
        return self._reduced(axes, keepdims, self.dtype, F.min("v"))

    def mean(self, axes=None, keepdims: bool = False):
        self._real("mean")
        return self._reduced(axes, keepdims, "f64", F.coalesce(F.sum(self._number().cast("double")), F.lit(0.0)) / self._count(axes))

    def std(self, axes=None, keepdims: bool = False):
        """Of the population."""
        self._real("std")
        n, v = self._count(axes), self._number().cast("double")
        if not self.sparse:
            return self._reduced(axes, keepdims, "f64", F.stddev_pop(v))
        mean = F.sum(v) / n
        return self._reduced(axes, keepdims, "f64", F.sqrt(F.greatest(F.sum(v * v) / n - mean * mean, F.lit(0.0))))

    def norm(self, axes=None, keepdims: bool = False):
        """Along axes; without, Frobenius of a vector or matrix, else of each matrix in the last two axes."""
        self._real("norm")
        if axes is None and self.ndim > 2:
            axes = (self.ndim - 2, self.ndim - 1)
        v = self._number().cast("double")
        return self._reduced(axes, keepdims, "f64", F.sqrt(F.coalesce(F.sum(v * v), F.lit(0.0))))

    def all(self) -> DataFrame:
        every = F.coalesce(F.bool_and(N.truth(F.col("v"))), F.lit(True))
        return self.df.agg(((F.count("*") == self.size) & every if self.sparse else every).alias("v"))

    def any(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.bool_or(N.truth(F.col("v"))), F.lit(False)).alias("v"))

    def argsort(self) -> Tensor:
        """Places of a vector's elements in ascending order: sorted ranges, each numbered apart and shifted by those before."""
        if self.ndim != 1:
            raise QueryError("argsort takes a vector")
        df = placed(self.to_dense().df, [F.col("v"), F.col("x0")], "at")
        return Tensor(df.select((F.col("at") - 1).cast("long").alias("x0"), F.col("x0").alias("v")), TensorSchema("i64", self.shape))

    # -- transforms

    def slice(self, bounds) -> Tensor | Any:
        """Indices drop their axis; slices and lists of indices keep it."""
        found = parse_axes(bounds, self.shape)
        if all(a.at is not None for a in found):
            return self.read(tuple(a.at for a in found))
        df, cols, shape = self.df, [], []
        for i, a in enumerate(found):
            c = F.col(x(i))
            if a.of is None:
                if a.at is not None or a.size != self.shape[i] or a.start:
                    df = df.where(a.keep(c))
                if a.at is None:
                    cols.append(a.rebased(c).alias(x(len(cols))))
            else:
                places: dict[int, list[int]] = {}
                for k, v in enumerate(a.of):
                    places.setdefault(v, []).append(k)
                df = df.where(a.keep(c))
                table = F.create_map(*[z for v, ks in places.items() for z in (F.lit(v).cast("long"), F.array(*[F.lit(k).cast("long") for k in ks]))])
                df = df.withColumn(f"__{i}", F.explode(F.element_at(table, c)))
                cols.append(F.col(f"__{i}").alias(x(len(cols))))
            if a.at is None:
                shape.append(a.size)
        return self._like(df.select(*cols, "v"), shape=tuple(shape))

    def broadcast(self, shape: S.Shape) -> Tensor:
        shape = tuple(shape)
        if S.broadcast(self.shape, shape) != shape:
            raise QueryError(f"can't broadcast {self.shape} to {shape}")
        t = self.expand_to(len(shape))
        df, new = t.df, [i for i, (have, want) in enumerate(zip(t.shape, shape)) if have != want]
        extent = tuple(shape[i] for i in new)
        if S.size(extent) > STRETCH and t.size <= STRETCH:
            # few rows, each repeated often: the new coordinates are a range, dealt to all tasks
            grid = df.sparkSession.range(S.size(extent)).select(*[F.expr(f"(id DIV {step}) % {dim}").cast("long").alias(x(i)) for i, dim, step in zip(new, extent, S.strides(extent))])
            return self._like(grid.crossJoin(F.broadcast(df.drop(*[x(i) for i in new]))).select(*xs(len(shape)), "v"), shape=shape)
        for i in new:
            df = repeated(df, x(i), shape[i])
        return self._like(df, shape=shape)

    def expand_dims(self, axes=None) -> Tensor:
        axes = [self.ndim] if axes is None else [a + self.ndim + 1 if a < 0 else a for a in ((axes,) if isinstance(axes, int) else axes)]
        n, old = self.ndim + len(axes), iter(range(self.ndim))
        if any(not 0 <= a < n for a in axes) or len(set(axes)) != len(axes):
            raise QueryError(f"invalid axes {axes}")
        where = [None if i in axes else next(old) for i in range(n)]
        cols = [(F.lit(0).cast("long") if w is None else F.col(x(w))).alias(x(i)) for i, w in enumerate(where)]
        out = self._like(self.df.select(*cols, "v"), shape=tuple(1 if w is None else self.shape[w] for w in where))
        return out if 0 in axes else replace(out, arrays=self.arrays)

    def reshape(self, shape) -> Tensor:
        shape = S.reshape(self.shape, shape)
        offset = F.lit(0).cast("long")
        for i, step in enumerate(S.strides(self.shape)):
            offset = offset + F.col(x(i)) * step
        df = self.df.select(offset.alias("o"), "v")
        cols = [F.expr(f"(o DIV {step}) % {dim}").alias(x(i)) for i, (dim, step) in enumerate(zip(shape, S.strides(shape)))]
        out = self._like(df.select(*cols, "v"), shape=shape)
        return replace(out, arrays=self.arrays) if shape[0] == self.shape[0] else out

    def transpose(self, perm=None) -> Tensor:
        perm = S.permutation(perm, self.ndim)
        return self._like(self.df.select(*[F.col(x(p)).alias(x(i)) for i, p in enumerate(perm)], "v"), shape=tuple(self.shape[p] for p in perm))

    def flip(self, axis: int) -> Tensor:
        i = S.axis(axis, self.ndim)
        return self._like(self.df.withColumn(x(i), F.lit(self.shape[i] - 1).cast("long") - F.col(x(i))))

    @staticmethod
    def concatenate(tensors: list[Tensor], axis: int = 0) -> Tensor:
        first, at = tensors[0], 0
        axis = S.axis(axis, first.ndim)
        dtype, sparse = promote(*[t.dtype for t in tensors]), all(t.sparse for t in tensors)
        out = None
        for t in tensors:
            if t.ndim != first.ndim or any(a != b for i, (a, b) in enumerate(zip(t.shape, first.shape)) if i != axis):
                raise QueryError("shapes differ off the axis")
            t = (t if sparse else t.to_dense()).cast(dtype)
            df = t.df.withColumn(x(axis), F.col(x(axis)) + F.lit(at).cast("long"))
            out, at = df if out is None else out.unionByName(df), at + t.shape[axis]
        return Tensor(out, TensorSchema(dtype, tuple(at if i == axis else d for i, d in enumerate(first.shape))), sparse)

    def split(self, parts, axis: int = 0) -> list[Tensor]:
        """Into equal parts, or parts of given sizes."""
        axis = S.axis(axis, self.ndim)
        sizes = [self.shape[axis] // parts] * parts if isinstance(parts, int) else list(parts)
        if sum(sizes) != self.shape[axis]:
            raise QueryError("the parts don't add up")
        ends = np.cumsum([0, *sizes]).tolist()
        return [self.slice((slice(None),) * axis + (slice(a, b),)) for a, b in zip(ends, ends[1:])]

    def tile(self, times: int, axis: int = 0) -> Tensor:
        axis = S.axis(axis, self.ndim)
        n = self.shape[axis]
        df = self.df.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
        df = df.withColumn(x(axis), F.col(x(axis)) + F.col("__k") * n).drop("__k")
        return self._like(df, shape=tuple(d * times if i == axis else d for i, d in enumerate(self.shape)))

    def diagonal(self) -> Tensor:
        if self.ndim < 2 or self.shape[-1] != self.shape[-2]:
            raise QueryError("diagonal takes square matrices")
        n = self.ndim
        return self._like(self.df.where(F.col(x(n - 1)) == F.col(x(n - 2))).select(*xs(n - 1), "v"), shape=self.shape[:-1])

    def with_diagonal(self, values: Tensor) -> Tensor:
        n = self.ndim
        on = F.col(x(n - 1)) == F.col(x(n - 2))
        diagonal = values.df.select(*xs(n - 1), F.col(x(n - 2)).alias(x(n - 1)), F.col("v").cast(spark_type(self.dtype)).alias("v"))
        return self._like(self.df.where(~on).unionByName(diagonal))

    def write(self, bounds, value) -> Tensor:
        """Set a region to a number or a broadcast tensor."""
        found = parse_axes(bounds, self.shape)
        hit = F.lit(True)
        for i, a in enumerate(found):
            if a.at is not None or a.of is not None or a.size != self.shape[i]:
                hit &= a.keep(F.col(x(i)))
        kind = spark_type(self.dtype)
        if not isinstance(value, Tensor):
            if not self.sparse:
                return self._like(self.df.withColumn("v", F.when(hit, F.lit(value).cast(kind)).otherwise(F.col("v"))))
            if value == 0:
                return self._like(self.df.where(~hit))
            if not all(a.at is not None for a in found):
                raise Unsupported("a non-zero number over a range of a sparse tensor is dense")
            value = Tensor.constant(self.df.sparkSession, (1,), value, self.dtype)
            shape: S.Shape = (1,)
        else:
            shape = tuple(a.size for a in found if a.at is None) or (1,)
        v = value.broadcast(shape)
        cols, k = [], 0
        for a in found:
            if a.at is not None:
                cols.append(F.lit(a.at).cast("long"))
                continue
            c = F.col(x(k))
            cols.append(F.element_at(F.array(*[F.lit(i).cast("long") for i in a.of]), (c + 1).cast("int")) if a.of is not None else c * a.step + a.start)
            k += 1
        new = v.df.select(*[c.cast("long").alias(x(i)) for i, c in enumerate(cols)], F.col("v").cast(kind).alias("v"))
        out = self._like(self.df.where(~hit).unionByName(new))
        return out._nonzero() if self.sparse else out

    # -- products

    def matmul(self, other: Tensor, blocks: int | None = None) -> Tensor:
        """Over the last two axes, leading ones broadcast.

        ``blocks``: edge of numpy blocks; by itself for dense matrices whose join on coordinates would make over
        ``JOINED`` rows; sparse ones of floats then take tiles of the result. Blocks are float64, so integer products beyond
        2**53 need ``blocks=0``.
        """
        self._real("matmul"), other._real("matmul")
        if self.ndim < 2 or other.ndim < 2 or self.shape[-1] != other.shape[-2]:
            raise QueryError(f"can't multiply {self.shape} by {other.shape}")
        if self.ndim == other.ndim == 2 and not (self.sparse or other.sparse):
            if blocks is None and promote(self.dtype, other.dtype) in FLOATS and self.shape[0] * self.shape[1] * other.shape[1] > JOINED:
                blocks = EDGE
            if blocks:
                from .block import matmul

                return matmul(self, other, blocks)
        elif self.ndim == other.ndim == 2 and blocks is None and promote(self.dtype, other.dtype) in FLOATS and self.shape[0] * self.shape[1] * other.shape[1] > JOINED:
            from .block import sparse_matmul

            out = sparse_matmul(self, other)
            if out is not None:
                return out
        lead = S.broadcast(self.shape[:-2] or (1,), other.shape[:-2] or (1,)) if self.ndim > 2 or other.ndim > 2 else ()
        n = len(lead)
        a = (self.expand_to(n + 2).broadcast((*lead, *self.shape[-2:])) if n else self).df
        b = (other.expand_to(n + 2).broadcast((*lead, *other.shape[-2:])) if n else other).df
        a = a.select(*[F.col(x(i)).alias(f"b{i}") for i in range(n)], F.col(x(n)).alias("i"), F.col(x(n + 1)).alias("k"), F.col("v").alias("l"))
        b = b.select(*[F.col(x(i)).alias(f"b{i}") for i in range(n)], F.col(x(n)).alias("k"), F.col(x(n + 1)).alias("j"), F.col("v").alias("r"))
        keys = [f"b{i}" for i in range(n)]
        dtype = promote(self.dtype, other.dtype, "i64")
        wide = "double" if dtype in FLOATS else "long"
        df = a.join(b, [*keys, "k"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("l").cast(wide) * F.col("r").cast(wide)).cast(spark_type(dtype)).alias("v"))
        cols = [F.col(c).alias(x(i)) for i, c in enumerate([*keys, "i", "j"])]
        out = Tensor(df.select(*cols, "v"), TensorSchema(dtype, (*lead, self.shape[-2], other.shape[-1])), self.sparse or other.sparse)
        return out._nonzero() if out.sparse else out
