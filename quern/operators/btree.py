"""Ordered sets of typed composite keys."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound, QueryError
from ..ranges import predicate, prefix
from ..schema import Column, TableSchema
from .table import placed


@dataclass(frozen=True)
class OrderedSet:
    """Distinct keys; every column is part of the key, and scans follow the columns' order."""

    df: DataFrame
    columns: tuple[Column, ...]
    backward: bool = False
    base: bool = True

    @staticmethod
    def create(spark: SparkSession, columns) -> OrderedSet:
        schema = TableSchema.of(columns)
        return OrderedSet(spark.createDataFrame([], schema.struct()), schema.key)

    @staticmethod
    def copy_from(columns, df: DataFrame) -> OrderedSet:
        schema = TableSchema.of(columns)
        return OrderedSet(schema.validate(df.select(*schema.names)).distinct(), schema.key)

    @property
    def schema(self) -> TableSchema:
        return TableSchema(self.columns)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def slice(self, key: tuple = (), bound=None, reverse: bool = False) -> OrderedSet:
        """Keys that begin with ``key`` and whose next column lies in ``bound``."""
        return replace(self, df=self.df.where(predicate(prefix(self.names, key, bound))), backward=self.backward != reverse, base=False)

    def reverse(self) -> OrderedSet:
        return replace(self, backward=not self.backward, base=False)

    def keys(self) -> DataFrame:
        return self.df.orderBy(*[F.col(c).desc_nulls_last() if self.backward else F.col(c).asc_nulls_first() for c in self.names])

    def placed(self, name: str = "position") -> DataFrame:
        """All keys with their places from 1."""
        return placed(self.df, [F.col(c).desc_nulls_last() if self.backward else F.col(c).asc_nulls_first() for c in self.names], name)

    def first(self) -> Row:
        found = self.first_key().collect()
        if not found:
            raise NotFound("the set is empty")
        return found[0]

    def first_key(self) -> DataFrame:
        return self.keys().limit(1)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def count(self, key: tuple = (), bound=None) -> int:
        return self.slice(key, bound).df.count()

    def contains(self, key: tuple) -> bool:
        return not self.slice(key).is_empty()

    def insert(self, rows: DataFrame | OrderedSet | list[tuple] | tuple) -> OrderedSet:
        """Set union with a key, keys, a table or another set."""
        if not self.base:
            raise QueryError("a slice can't be written to")
        if isinstance(rows, OrderedSet):
            rows = rows.df
        if isinstance(rows, (list, tuple)):
            rows = self.df.sparkSession.createDataFrame(rows if isinstance(rows, list) else [rows], self.schema.struct())
        return replace(self, df=self.df.unionByName(self.schema.validate(rows.select(*self.names))).distinct())

    def delete(self, key: tuple = (), bound=None) -> OrderedSet:
        """Without a range, all."""
        if not self.base:
            raise QueryError("a slice can't be written to")
        hit = predicate(prefix(self.names, key, bound))
        return replace(self, df=self.df.where(~F.coalesce(hit, F.lit(False))))

    def difference(self, other: OrderedSet) -> OrderedSet:
        on = [self.df[c].eqNullSafe(other.df[c]) for c in self.names]
        return replace(self, df=self.df.join(other.df, on, "left_anti"))

    def intersection(self, other: OrderedSet) -> OrderedSet:
        return replace(self, df=self.df.intersect(other.df.select(*self.names)))
