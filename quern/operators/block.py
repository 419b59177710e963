"""Products too large for coordinate joins: dense matrices in square numpy blocks, rows (i, j, data); sparse ones in tiles of the result."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TensorSchema, promote, spark_type
from ..sources.storage import drop, new_path, written
from .tensor import JOINED, Tensor


#: Target blocks whose sums a task holds before it passes them on.
HELD = 64
#: Cells of a sparse operand in one band of the result's rows or columns, and bands at most.
BAND, BANDS = 1_000_000, 64
#: Products for which one more band of rows is worth while.
TILE = 1 << 24
#: Columns of a tile that a task takes.
STRIP = 1024
#: Products that a tile's task holds at once, and rows of a batch that it passes on.
PRODUCTS, PASSED = 1 << 20, 1 << 16


def pack(t: Tensor, edge: int) -> DataFrame:
    """(i, j, data): edge x edge float64 blocks, row-major; edges beyond the matrix are zero."""
    rows = t.df.select(F.expr(f"x0 DIV {edge}").alias("i"), F.expr(f"x1 DIV {edge}").alias("j"), (F.col("x0") % edge * edge + F.col("x1") % edge).cast("int").alias("o"), F.col("v").cast("double").alias("v"))

    def build(table: pa.Table) -> pa.Table:
        out = np.zeros(edge * edge)
        out[table.column("o").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"i": table.column("i").slice(0, 1), "j": table.column("j").slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

    return rows.groupBy("i", "j").applyInArrow(build, "i long, j long, data binary")


def unpack(blocks: DataFrame, shape: tuple[int, int], edge: int) -> Tensor:
    def run(batches):
        for batch in batches:
            for i, j, data in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                rows, cols = min(edge, shape[0] - i * edge), min(edge, shape[1] - j * edge)
                block = np.frombuffer(data).reshape(edge, edge)[:rows, :cols]
                a, b = np.indices(block.shape)
                yield pa.RecordBatch.from_arrays([pa.array(a.ravel() + i * edge), pa.array(b.ravel() + j * edge), pa.array(block.ravel())], names=["x0", "x1", "v"])

    return Tensor(blocks.mapInArrow(run, "x0 long, x1 long, v double"), TensorSchema("f64", shape))


def matmul(a: Tensor, b: Tensor, edge: int = 256) -> Tensor:
    """Blocks meet on the inner block index; products are added up for each target block, one at a time."""
    left = pack(a, edge).select("i", F.col("j").alias("k"), F.col("data").alias("l"))
    right = pack(b, edge).select(F.col("i").alias("k"), "j", F.col("data").alias("r"))

    def multiply(batches):
        """Products, those of one target block added up while at most HELD blocks wait."""
        held: dict[tuple, np.ndarray] = {}

        def made():
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["i", "j", "data"])
            held.clear()

        for batch in batches:
            for i, j, l, r in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                x = np.frombuffer(l).reshape(edge, edge) @ np.frombuffer(r).reshape(edge, edge)
                held[i, j] = held[i, j] + x if (i, j) in held else x
                if len(held) > HELD:
                    yield from made()
        if held:
            yield from made()

    def add(batches):
        at, total = None, None
        for batch in batches:
            for i, j, data in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if (i, j) != at:
                    if at:
                        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([total.tobytes()], pa.binary())], names=["i", "j", "data"])
                    at, total = (i, j), np.zeros(edge * edge)
                total += np.frombuffer(data)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([total.tobytes()], pa.binary())], names=["i", "j", "data"])

    schema = "i long, j long, data binary"
    products = left.join(right, "k").select("i", "j", "l", "r").mapInArrow(multiply, schema)
    return unpack(products.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(add, schema), (a.shape[0], b.shape[1]), edge)


def _band(df: DataFrame, axis: str, n: int) -> Column:
    """The number of an axis' band, of n about equal ones by count of cells; what has the same place is in the same band."""
    cuts = sorted(set(df.agg(F.percentile_approx(axis, [k / n for k in range(1, n)], 100 * n)).first()[0])) if n > 1 else []
    return reduce(lambda a, b: a + b, [(F.col(axis) >= c).cast("long") for c in cuts], F.lit(0).cast("long"))


def sparse_matmul(a: Tensor, b: Tensor) -> Tensor | None:
    """Products are made and added up inside tiles of the result, so that only the operands' cells are dealt out.

    Each cell goes to the tiles where the other operand has its inner index. None if a coordinate join makes at most
    ``JOINED`` rows. Tiles are kept in the shared folder, and each is read for every ``STRIP`` of its columns. A task
    holds its tile and the products of some rows of ``a``.
    """
    left = written(a.df.select(F.col("x0").alias("i"), F.col("x1").alias("k"), F.col("v").cast("double").alias("v")), "left")
    right = written(b.df.select(F.col("x0").alias("k"), F.col("x1").alias("j"), F.col("v").cast("double").alias("v")), "right")
    met = left.groupBy("k").agg(F.count("*").alias("l")).join(right.groupBy("k").agg(F.count("*").alias("r")), "k")
    cells, others, products = (x or 0 for x in met.agg(F.sum("l"), F.sum("r"), F.sum(F.col("l").cast("double") * F.col("r"))).first())
    if products <= JOINED:
        return None
    # enough tiles for the work, while b's copies stay below an eighth of the products
    rows, columns = (min(BANDS, -(-n // BAND)) for n in (cells, others))
    rows = max(rows, min(BANDS, int(products // TILE), int(products // (8 * others))))
    left, right = left.withColumn("a", _band(left, "i", rows)), right.withColumn("b", _band(right, "j", columns))
    tile = (F.col("a") * columns + F.col("b")).alias("tile")
    sent = left.join(right.select("k", "b").distinct(), "k").select(tile, F.lit(1).alias("side"), F.col("i").alias("p"), F.col("k").alias("q"), "v")
    held = right.join(left.select("k", "a").distinct(), "k").select(tile, F.lit(0).alias("side"), F.col("k").alias("p"), F.col("j").alias("q"), "v")

    # a tile is read by a task for each strip of its columns: files of few columns take fewer bits for each
    path = new_path(a.df.sparkSession, "tiles")
    dealt = sent.unionByName(held).repartition(rows * columns, "tile").sortWithinPartitions("tile", "side", "p", "q")
    dealt.write.partitionBy("tile").parquet(path)
    drop(left, right)
    spark, kept = a.df.sparkSession, a.df.sparkSession.read.schema("side int, p long, q long, v double, tile long").parquet(path)
    found = sorted(tuple(r) for r in kept.where("side = 0").groupBy("tile").agg(F.count_distinct("q")).collect())
    strips = [-(-n // STRIP) for _, n in found]
    ends = np.cumsum([0, *strips]).tolist()
    asked = spark.createDataFrame([(t, x, y) for (t, _), x, y in zip(found, ends, ends[1:])], "tile long, first long, past long")
    tasks = spark.range(0, ends[-1], 1, ends[-1]).join(F.broadcast(asked), F.expr("id >= first AND id < past")).select("tile", (F.col("id") - F.col("first")).alias("strip"))

    def multiply(batches):
        """Some columns of a tile: its cells of b by (k, j), then those of a by (i, k), whole rows of a at a time."""

        def added(i, lo, n, v):
            """Products of some rows, summed by cell."""
            take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            w = np.repeat(v, n) * held[2][take]
            own, rank = np.unique(i, return_inverse=True)
            key = np.repeat(rank * len(held[3]), n) + held[1][take]
            if len(own) * len(held[3]) <= 4 * len(key):
                sums = np.bincount(key, w)
                key = np.flatnonzero(sums)
                sums = sums[key]
            else:
                order = np.argsort(key, kind="stable")  # merges the ascending runs of each cell of a
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                key, sums = key[first], np.add.reduceat(w[order], first) if len(first) else w
            out = pa.RecordBatch.from_arrays([pa.array(own[key // len(held[3])]), pa.array(held[3][key % len(held[3])]), pa.array(sums)], names=["x0", "x1", "v"])
            for k in range(0, len(key), PASSED):
                yield out.slice(k, PASSED)

        def whole(i, k, v):
            lo = np.searchsorted(held[0], k)
            n = np.searchsorted(held[0], k, "right") - lo
            total, starts = np.concatenate([[0], np.cumsum(n)]), np.concatenate([np.flatnonzero(np.diff(i, prepend=i[0] - 1)), [len(i)]])
            x = 0
            while x < len(starts) - 1:
                y = max(x + 1, int(np.searchsorted(total[starts], total[starts[x]] + PRODUCTS, "right")) - 1)
                part = slice(starts[x], starts[y])
                yield from added(i[part], lo[part], n[part], v[part])
                x = y

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for tile, strip in zip(*[batch.column(k).to_pylist() for k in range(2)]):
                t = pq.read_table(f"{folder}/tile={tile}", columns=["side", "p", "q", "v"], filesystem=store, partitioning=None)
                side, p, q, v = (t.column(k).to_numpy() for k in range(4))
                cut = int(np.searchsorted(side, 1))
                own = np.unique(q[:cut])[strip * STRIP : (strip + 1) * STRIP]
                mine = np.flatnonzero((q[:cut] >= own[0]) & (q[:cut] <= own[-1]))
                held = [p[mine], np.searchsorted(own, q[mine]), v[mine], own]
                near = cut + np.flatnonzero(np.isin(q[cut:], held[0]))
                if len(near):
                    yield from whole(p[near], q[near], v[near])

    dtype = promote(a.dtype, b.dtype)
    out = tasks.mapInArrow(multiply, "x0 long, x1 long, v double").select("x0", "x1", F.col("v").cast(spark_type(dtype)).alias("v"))
    return Tensor(out, TensorSchema(dtype, (a.shape[0], b.shape[1])), True)._nonzero()
