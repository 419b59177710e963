"""Ranges over columns and axes, as predicates that Spark pushes down."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F

from .errors import QueryError


@dataclass(frozen=True)
class Bound:
    value: Any
    inclusive: bool = True


@dataclass(frozen=True)
class Range:
    """An interval; None leaves a side open. A Python slice means [start, stop)."""

    low: Bound | None = None
    high: Bound | None = None

    @staticmethod
    def of(x) -> Range | Any:
        """Range for slices and ranges, any other value for itself (equality)."""
        if isinstance(x, slice):
            if x.step is not None:
                raise QueryError("a column range has no step")
            return Range(None if x.start is None else Bound(x.start), None if x.stop is None else Bound(x.stop, False))
        return x

    def predicate(self, column: Expr) -> Expr:
        parts = []
        if self.low is not None:
            parts.append(column >= self.low.value if self.low.inclusive else column > self.low.value)
        if self.high is not None:
            parts.append(column <= self.high.value if self.high.inclusive else column < self.high.value)
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def contains(self, other) -> bool:
        if not isinstance(other, Range):
            other = Range(Bound(other), Bound(other))

        def inside(mine: Bound | None, theirs: Bound | None, sign: int) -> bool:
            if mine is None:
                return True
            if theirs is None:
                return False
            if mine.value == theirs.value:
                return mine.inclusive or not theirs.inclusive
            return (theirs.value > mine.value) if sign > 0 else (theirs.value < mine.value)

        return inside(self.low, other.low, 1) and inside(self.high, other.high, -1)


def predicate(ranges: dict[str, Any]) -> Expr:
    """Conjunction over columns; null equals null, as in an ordered key set."""
    parts = []
    for name, x in ranges.items():
        x = Range.of(x)
        parts.append(x.predicate(F.col(name)) if isinstance(x, Range) else F.col(name).isNull() if x is None else F.col(name) == F.lit(x))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def contained(outer: dict[str, Any], inner: dict[str, Any]) -> bool:
    for name, x in outer.items():
        x = Range.of(x)
        if name not in inner:
            return False
        y = Range.of(inner[name])
        if isinstance(x, Range) and not x.contains(y) or not isinstance(x, Range) and x != y:
            return False
    return True


def prefix(columns: list[str], key: tuple, bound=None) -> dict[str, Any]:
    """A range over an ordered key set: equal leading columns, then at most one interval."""
    if len(key) + (bound is not None) > len(columns):
        raise QueryError("the range has more columns than the key")
    out = dict(zip(columns, key))
    if bound is not None:
        out[columns[len(key)]] = bound
    return out


@dataclass(frozen=True)
class Axis:
    """Bounds of one axis: an index (which drops it), start:stop:step, or a list of indices."""

    at: int | None = None
    start: int = 0
    stop: int = 0
    step: int = 1
    of: tuple[int, ...] | None = None

    @staticmethod
    def parse(x, dim: int) -> Axis:
        def place(i: int, most: int) -> int:
            j = i + dim if i < 0 else i
            if not 0 <= j <= most:
                raise QueryError(f"index {i} is out of bounds for an axis of {dim}")
            return j

        if isinstance(x, int):
            return Axis(at=place(x, dim - 1))
        if isinstance(x, slice):
            axis = Axis(start=place(x.start or 0, dim), stop=dim if x.stop is None else place(x.stop, dim), step=x.step or 1)
            if axis.step < 1 or axis.size < 1:
                raise QueryError(f"empty or backward slice of an axis of {dim}")
            return axis
        if isinstance(x, (list, tuple)):
            if not x:
                raise QueryError("empty list of indices")
            return Axis(of=tuple(place(i, dim - 1) for i in x))
        raise QueryError(f"invalid bound {x!r}")

    @property
    def size(self) -> int:
        return 1 if self.at is not None else len(self.of) if self.of is not None else -(-(self.stop - self.start) // self.step)

    def keep(self, x: Expr) -> Expr:
        if self.at is not None:
            return x == self.at
        if self.of is not None:
            return x.isin(*set(self.of))
        inside = (x >= self.start) & (x < self.stop)
        return inside if self.step == 1 else inside & ((x - self.start) % self.step == 0)

    def rebased(self, x: Expr) -> Expr:
        return x - self.start if self.step == 1 else F.floor((x - self.start) / self.step).cast("long")


def axes(bounds, shape: tuple[int, ...]) -> list[Axis]:
    bounds = bounds if isinstance(bounds, tuple) else (bounds,)
    if len(bounds) > len(shape):
        raise QueryError(f"{len(bounds)} bounds for {len(shape)} axes")
    return [Axis.parse(b, d) for b, d in zip(bounds + (slice(None),) * (len(shape) - len(bounds)), shape)]
