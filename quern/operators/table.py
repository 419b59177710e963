"""Keyed tables: lazy, immutable views over a DataFrame and its declared schema."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Conflict, NotFound, QueryError
from ..ranges import contained, predicate
from ..schema import TableSchema
from ..sources.storage import written


def placed(df: DataFrame, by: list, name: str = "position") -> DataFrame:
    """Every row's place from 1 in the order ``by``: sorted ranges, each numbered apart and shifted by those before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    kept = written(ranged, "placed")  # the sampled bounds are fixed by what is written
    part = F.shiftrightunsigned("__at", 33)
    kept = kept.withColumn("__part", part).withColumn("__at", F.col("__at") - F.shiftleft(part, 33))
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    counts = counts.select(F.col("__part").alias("__of"), (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")).alias("__before"))
    out = kept.join(F.broadcast(counts), F.col("__part") == F.col("__of"))
    return out.withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__at", "__part", "__of", "__before")


def _last(df: DataFrame, keys: list[str], rest: list[str], by: list[str]) -> DataFrame:
    """Of the rows of each key, that with the greatest ``by``, then of the greatest other columns; combined map-side."""
    kept = [c for c in rest if c not in by]
    if not kept and not by:
        return df.select(*keys).distinct()
    last = df.groupBy(*keys).agg(F.max(F.struct(*by, *kept)).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in kept])


def _by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str, *more: str) -> DataFrame:
    """The columns of ``left`` (and ``more`` of the right), joined on keys of which nulls are equal too."""
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    right = right.select(*[F.col(k).alias(n) for k, n in names.items()], *more)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, on, how).drop(*names.values())


@dataclass(frozen=True)
class Table:
    """Rows, their schema, and the view put on them.

    ``order``/``backward``/``most`` only describe the scan; ``rows()`` applies them, so counting or filtering never
    sorts. Writes return a new base table and are refused on views. ``strict`` asks that some index supports each
    range and order, as a store of B-trees must; Spark needs none.
    """

    df: DataFrame
    schema: TableSchema
    order: tuple[str, ...] = ()
    backward: bool = False
    most: int | None = None
    ranges: dict[str, Any] = field(default_factory=dict)
    base: bool = True
    strict: bool = False
    tie: tuple[str, ...] = ()

    # -- constructors

    @staticmethod
    def create(spark: SparkSession, schema: TableSchema) -> Table:
        return Table(spark.createDataFrame([], schema.struct()), schema)

    @staticmethod
    def load(spark: SparkSession, schema: TableSchema, rows: list[tuple]) -> Table:
        return Table.create(spark, schema).upsert_rows(spark.createDataFrame(rows, schema.struct()) if rows else spark.createDataFrame([], schema.struct()))

    @staticmethod
    def copy_from(schema: TableSchema, df: DataFrame, unique: bool = False) -> Table:
        """A table from any DataFrame with its columns. The last of rows with equal keys is not defined: one stays."""
        df = schema.validate(df.select(*schema.names))
        return Table(df if unique or not schema.key else df.dropDuplicates(schema.key_names), schema)

    def copy(self) -> Table:
        """A base table with this view's rows, materialised in the shared folder."""
        return Table(written(self.rows() if self.most is not None else self.df.select(*self.columns), "table"), self.schema)

    # -- introspection

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def key_columns(self) -> list[str]:
        return self.schema.key_names

    key_names = key_columns

    # -- views

    def where(self, **ranges) -> Table:
        """Rows whose columns equal a value or lie in a slice [start, stop) or a Range."""
        self._no_limit("sliced")
        for name in ranges:
            self.schema.column(name)
        if self.ranges and set(ranges) & set(self.ranges) and not contained({k: v for k, v in self.ranges.items() if k in ranges}, ranges):
            raise QueryError("a slice of a slice must lie inside it")
        if self.strict and not self.schema.supports(list({*self.ranges, *ranges})):
            raise QueryError(f"no index supports a range of {list(ranges)}")
        return replace(self, df=self.df.where(predicate(ranges)), ranges=self.ranges | ranges, base=False)

    slice = where

    def filter(self, condition: Expr) -> Table:
        """Any predicate (beyond ranges)."""
        self._no_limit("filtered")
        return replace(self, df=self.df.where(condition), base=False)

    def select(self, columns: list[str]) -> Table:
        """Columns in the caller's order; the result has no key. The scan's order and limit stay in force."""
        schema = self.schema.selected(list(columns))
        if self.most is not None:
            return Table(self.rows().select(*columns), schema, base=False)
        hidden = [c for c in (*self.order, *self._ties()) if c not in columns and c in self.df.columns]
        return replace(self, df=self.df.select(*columns, *dict.fromkeys(hidden)), schema=schema, base=False, tie=tuple(self._ties()))

    def order_by(self, columns: list[str], reverse: bool = False) -> Table:
        self._no_limit("ordered")
        for c in columns:
            self.schema.column(c)
        if self.order and list(self.order[: len(columns)]) != list(columns):
            raise QueryError("an ordered view takes only a prefix of its order")
        if self.strict and not self.schema.supports(list(columns)):
            raise QueryError(f"no index supports the order {columns}")
        return replace(self, order=tuple(columns), backward=self.backward != reverse, base=False)

    def reverse(self) -> Table:
        self._no_limit("reversed")
        return replace(self, backward=not self.backward, base=False)

    def limit(self, n: int) -> Table:
        """The first n rows of the scan; a later limit replaces an earlier one."""
        if n < 0:
            raise QueryError("a limit is not negative")
        return replace(self, most=n, base=False)

    def _ties(self) -> list[str]:
        return list(self.tie) or self.schema.key_names

    def _no_limit(self, what: str) -> None:
        if self.most is not None:
            raise QueryError(f"a limited table can't be {what}")

    def _sorting(self) -> list[Expr]:
        names = list(dict.fromkeys([*self.order, *self._ties()]))
        return [F.col(c).desc_nulls_last() if self.backward else F.col(c).asc_nulls_first() for c in names if c in self.df.columns]

    # -- reads

    def rows(self) -> DataFrame:
        """The scan: ordered by the view's order and then the key, cut to the limit (a top-k when both are there)."""
        df, by = self.df, self._sorting()
        if by:
            df = df.orderBy(*by)
        if self.most is not None:
            df = df.limit(self.most)
        return df.select(*self.columns)

    def numbered(self, name: str = "position") -> DataFrame:
        """The limited scan with each row's place from 1: a window over the few rows of a limit."""
        if self.most is None:
            raise QueryError("only a limited scan is numbered")
        by = self._sorting()
        df = self.df.orderBy(*by).limit(self.most).withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long"))
        return df.select(*self.columns, name)

    def placed(self, name: str = "position") -> DataFrame:
        """The whole scan with each row's place from 1, in whatever order the rows come; no task holds them all."""
        self._no_limit("placed")
        return placed(self.df, self._sorting(), name).select(*self.columns, name)

    def read(self, key: tuple) -> Row | None:
        self._no_limit("read by key")
        if len(key) != len(self.schema.key):
            raise QueryError("a point read needs the whole key")
        found = self.df.where(predicate(dict(zip(self.schema.key_names, key)))).limit(1).collect()
        return found[0] if found else None

    def read_rows(self, keys: DataFrame) -> DataFrame:
        """The rows of many keys at once; a null is a key like any other."""
        return _by_key(self.df, keys, self.schema.key_names, "left_semi").select(*self.columns)

    def contains(self, key: tuple | None = None, **ranges) -> bool:
        if key is not None:
            return self.read(key) is not None
        return not (self.where(**ranges) if ranges else self).is_empty()

    def is_empty(self) -> bool:
        return self.most == 0 or self.df.isEmpty()

    def count(self, **ranges) -> int:
        return self.counted(**ranges).first()[0]

    def counted(self, **ranges) -> DataFrame:
        view = self.where(**ranges) if ranges else self
        df = view.df if view.most is None else view.df.limit(view.most)
        return df.agg(F.count("*").alias("n"))

    def aggregate(self, columns: list[str], **aggregates: Expr) -> DataFrame:
        """One row for each distinct value of ``columns``; Spark aggregates partially before it shuffles."""
        df = self.df if self.most is None else self.rows()
        return df.groupBy(*columns).agg(*[e.alias(n) for n, e in aggregates.items()])

    def rolled_up(self, columns: list[str], **aggregates: Expr) -> DataFrame:
        """``aggregate`` for every prefix of ``columns``, the empty one too (an extension)."""
        return self.df.rollup(*columns).agg(*[e.alias(n) for n, e in aggregates.items()])

    def ranked(self, by: list[str], name: str = "rank") -> DataFrame:
        """Each row's place from 1, in the view's order, among those alike in ``by`` (an extension)."""
        return self.df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*self._sorting())).cast("long"))

    def join(self, other: Table, on: list[str], how: str = "inner") -> DataFrame:
        return self.df.join(other.df, on, how)

    # -- writes

    def _writable(self) -> None:
        if not self.base:
            raise QueryError("a view can't be written to")

    def _row(self, key: tuple, values: tuple) -> DataFrame:
        if len(key) != len(self.schema.key) or len(values) != len(self.schema.values):
            raise QueryError("wrong number of key or value columns")
        spark = self.df.sparkSession
        return self.schema.validate(spark.createDataFrame([(*key, *values)], self.schema.struct()))

    def upsert(self, key: tuple, values: tuple = ()) -> Table:
        return self._put(self._row(key, values))

    def upsert_rows(self, rows: DataFrame, latest: str | None = None) -> Table:
        """Insert or replace by key.

        Of rows that share a key, that with the greatest value of the column ``latest`` stays; without one, and among
        equals, the greatest of the rows themselves, so that the result does not depend on how they come.
        """
        names, keys = self.schema.names, self.schema.key_names
        rows = rows.select(*names, *([F.col(latest).alias("__latest")] if latest else []))
        last = _last(rows, keys, [c for c in names if c not in keys], ["__latest"] if latest else [])
        return self._put(self.schema.validate(last.select(*names)))

    def _put(self, rows: DataFrame) -> Table:
        self._writable()
        return replace(self, df=_by_key(self.df, rows, self.schema.key_names, "left_anti").unionByName(rows))

    def insert(self, key: tuple, values: tuple = ()) -> Table:
        if self.contains(key):
            raise Conflict(f"there is a row with the key {key}")
        return self.upsert(key, values)

    def insert_rows(self, rows: DataFrame) -> Table:
        """Append rows whose keys are new; a key that is there, or comes twice, fails the query when it runs.

        Only the new rows' keys are looked up in the table, which is neither sorted nor windowed.
        """
        self._writable()
        rows, keys = self.schema.validate(rows.select(*self.schema.names)), self.schema.key_names
        twice = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
        there = _by_key(self.df, twice, keys, "left_semi").select(*keys).withColumn("__there", F.lit(True))
        met = _by_key(twice, there, keys, "left", "__there").withColumn("__bad", F.col("__there").isNotNull() | (F.col("__n") > 1))
        new = _by_key(rows, met, keys, "inner", "__bad").withColumn("__new", F.when(F.col("__bad"), F.raise_error(F.lit("a key is there already")).cast("boolean")).otherwise(F.lit(True))).drop("__bad")
        return replace(self, df=self.df.unionByName(new.where("__new").drop("__new")))

    def update(self, values: dict[str, Any], **ranges) -> Table:
        """Set value columns of the rows in a range (all, without one)."""
        self._writable()
        allowed = {c.name for c in self.schema.values}
        if bad := set(values) - allowed:
            raise QueryError(f"only value columns can be set, not {sorted(bad)}")
        hit = predicate(ranges)
        cells = {c: F.when(hit, self.schema.column(c).checked(v if isinstance(v, Expr) else F.lit(v))).otherwise(F.col(c)) for c, v in values.items()}
        return replace(self, df=self.df.withColumns(cells))

    def delete(self, key: tuple) -> Table:
        if len(key) != len(self.schema.key):
            raise NotFound(key)
        return self.truncate(**dict(zip(self.schema.key_names, key)))

    def truncate(self, **ranges) -> Table:
        self._writable()
        return replace(self, df=self.df.where(~F.coalesce(predicate(ranges), F.lit(False))) if ranges else self.df.limit(0))

    def delete_rows(self, keys: DataFrame) -> Table:
        self._writable()
        return replace(self, df=_by_key(self.df, keys, self.schema.key_names, "left_anti"))

    def merged(self, deltas: list[tuple[DataFrame, DataFrame]]) -> Table:
        """The table after a sequence of (upserted rows, deleted keys): the last writer of a key wins, in one delta the greatest row.

        One shuffle by key whatever the number of deltas: every version of a row is tagged with its place.
        """
        self._writable()
        keys, names = self.schema.key_names, self.schema.names
        rows = [self.df.select(*names, F.lit(0).alias("__at"), F.lit(False).alias("__gone"))]
        for i, (puts, gone) in enumerate(deltas):
            rows.append(self.schema.validate(puts.select(*names)).select(*names, F.lit(2 * i + 1).alias("__at"), F.lit(False).alias("__gone")))
            blank = [F.col(c) if c in keys else F.lit(None).cast(self.df.schema[c].dataType).alias(c) for c in names]
            rows.append(gone.select(*blank, F.lit(2 * i + 2).alias("__at"), F.lit(True).alias("__gone")))
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        rest = [c for c in [*names, "__gone"] if c not in keys]
        return replace(self, df=_last(every, keys, rest, ["__at"]).where("NOT __gone").select(*names))
