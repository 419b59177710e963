"""Graphs: node tables and edges (from_id, to_id), foreign-key hops and breadth-first matches."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, NotFound, QueryError
from ..sources.storage import written
from .table import Table
from .tensor import Tensor


@dataclass(frozen=True)
class Edge:
    """A set of directed edges: a two-dimensional sparse Boolean tensor as (from_id, to_id)."""

    df: DataFrame

    @staticmethod
    def of(df: DataFrame, source: str, target: str) -> Edge:
        return Edge(df.select(F.col(source).cast("long").alias("from_id"), F.col(target).cast("long").alias("to_id")).dropna().distinct())

    @staticmethod
    def from_tensor(t: Tensor) -> Edge:
        return Edge(t.to_sparse().df.select(F.col("x0").alias("from_id"), F.col("x1").alias("to_id")))

    def tensor(self, rows: int, columns: int) -> Tensor:
        return Tensor.from_frame(self.df.withColumn("v", F.lit(True)), ["from_id", "to_id"], "v", (rows, columns), "bool")

    def link(self, source: int, target: int) -> Edge:
        return Edge(self.df.unionByName(self.df.sparkSession.createDataFrame([(source, target)], "from_id long, to_id long")).distinct())

    def unlink(self, source: int, target: int) -> Edge:
        return Edge(self.df.where(~((F.col("from_id") == source) & (F.col("to_id") == target))))

    def degree(self, incoming: bool = False) -> DataFrame:
        return self.df.groupBy(F.col("to_id" if incoming else "from_id").alias("id")).agg(F.count("*").alias("degree"))

    def primary(self, ids: DataFrame) -> DataFrame:
        """Targets of the edges that leave these ids (one column ``id``)."""
        return self.df.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()

    def foreign(self, ids: DataFrame) -> DataFrame:
        """Sources of the edges that reach these ids."""
        return self.df.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()

    def match(self, ids: DataFrame, degrees: int = 1, incoming: bool = True) -> DataFrame:
        """(id, distance) of what is reached from ``ids`` within so many steps, without ``ids`` themselves.

        Only the frontier is joined with the edges; each step is written, so lineage stays short and lost
        executors cost one step. It stops early when nothing new is met.
        """
        at, to = ("to_id", "from_id") if incoming else ("from_id", "to_id")
        seen = written(ids.select(F.col("id").cast("long").alias("id")).distinct().withColumn("distance", F.lit(0)), "bfs")
        frontier = seen
        for step in range(1, degrees + 1):
            near = self.df.join(frontier.select(F.col("id").alias(at)), at, "left_semi").select(F.col(to).alias("id")).distinct()
            frontier = written(near.join(seen, "id", "left_anti").withColumn("distance", F.lit(step)), "bfs")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen.where("distance > 0")


@dataclass(frozen=True)
class Graph:
    """Tables by name with one integer key each; ``keys``: (table, column) -> table it refers to."""

    tables: dict[str, Table]
    keys: dict[tuple[str, str], str] = field(default_factory=dict)
    edges: dict[str, Edge] = field(default_factory=dict)

    def __post_init__(self):
        for (table, column), target in self.keys.items():
            self.table(table).schema.column(column)
            if len(self.table(target).schema.key) != 1:
                raise QueryError(f"{target} has no single key")

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise NotFound(name)
        return self.tables[name]

    def foreign_key(self, table: str, column: str) -> Edge:
        t = self.table(table)
        if (table, column) not in self.keys:
            raise NotFound(f"{table}.{column}")
        return Edge.of(t.df, t.schema.key_names[0], column)

    def read_vector(self, table: str, ids: DataFrame) -> DataFrame:
        key = self.table(table).schema.key_names[0]
        return self.table(table).df.join(ids.select(F.col("id").alias(key)), key, "left_semi")

    def max_id(self, table: str) -> DataFrame:
        return self.table(table).df.agg(F.max(self.table(table).schema.key_names[0]).alias("id"))

    def upsert(self, table: str, key: tuple, values: tuple) -> Graph:
        """Foreign keys must refer to rows that are there."""
        t = self.table(table)
        cells = dict(zip(t.schema.names, (*key, *values)))
        for (name, column), target in self.keys.items():
            if name == table and cells[column] is not None and not self.table(target).contains((cells[column],)):
                raise NotFound(f"{target} has no row {cells[column]}")
        return replace(self, tables=self.tables | {table: t.upsert(key, values)})

    def update_row(self, table: str, key: tuple, values: dict) -> Graph:
        for (name, column), target in self.keys.items():
            if name == table and values.get(column) is not None and not self.table(target).contains((values[column],)):
                raise NotFound(f"{target} has no row {values[column]}")
        t = self.table(table)
        return replace(self, tables=self.tables | {table: t.update(values, **dict(zip(t.schema.key_names, key)))})

    def delete_row(self, table: str, key: tuple, cascade: bool = False) -> Graph:
        """Rows that refer to it are deleted too, or forbid it."""
        gone = self.table(table).df.sparkSession.createDataFrame([(int(key[0]),)], "id long")
        return self._delete(table, gone, cascade)

    def _delete(self, table: str, ids: DataFrame, cascade: bool) -> Graph:
        out = self
        for (name, column), target in self.keys.items():
            if target != table:
                continue
            t = out.table(name)
            hit = t.df.join(ids.select(F.col("id").alias(column)), column, "left_semi").select(F.col(t.schema.key_names[0]).alias("id"))
            if hit.isEmpty():
                continue
            if not cascade:
                raise Conflict(f"rows of {name} refer to it")
            out = out._delete(name, written(hit, "cascade"), True)
        t = out.table(table)
        key = t.schema.key_names[0]
        return replace(out, tables=out.tables | {table: t.delete_rows(ids.select(F.col("id").alias(key)))})
