"""Tuples (arrays) and maps; indices from 0, negative ones from the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def at(t: Column, i: int) -> Column:
    """The element; an index out of bounds is an error."""
    return F.element_at(t, i + 1 if i >= 0 else i)


def cut(t: Column, start: int = 0, stop: int | None = None) -> Column:
    n = F.size(t)
    a = _c(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if stop is None else F.least(_c(stop), n) if stop >= 0 else n + stop
    return F.slice(t, a + 1, F.greatest(b - a, F.lit(0)))


def append(t: Column, *items) -> Column:
    return F.concat(t, F.array(*map(_c, items)))


def concatenate(*ts: Column) -> Column:
    return F.concat(*ts)


def contains(t: Column, x) -> Column:
    return F.array_contains(t, x)


def length(t: Column) -> Column:
    return F.size(t).cast("long")


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mapped(t: Column, op: Callable[[Column], Column]) -> Column:
    return F.transform(t, op)


def filtered(t: Column, op: Callable[[Column], Column]) -> Column:
    return F.filter(t, op)


def fold(t: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(t, start, op)


def total(t: Column) -> Column:
    return F.aggregate(t, F.lit(0.0), lambda a, x: a + x.cast("double"))


def product(t: Column) -> Column:
    return F.aggregate(t, F.lit(1.0), lambda a, x: a * x.cast("double"))


def zipped(a: Column, b: Column) -> Column:
    """Pairs; arrays of unequal lengths are an error."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("l"), y.alias("r")))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("zip of unequal lengths"))).otherwise(both)


def span(start, stop=None, step: int = 1) -> Column:
    """n, or [start, stop) by step; descending where start lies above stop."""
    if stop is None:
        start, stop = 0, start
    a, b = _c(start).cast("long"), _c(stop).cast("long")
    up = F.sequence(a, b - 1, F.lit(step).cast("long"))
    down = F.sequence(a, b + 1, F.lit(-step).cast("long"))
    return F.when(a < b, F.when(a < b, up)).when(a > b, down).otherwise(F.array().cast("array<bigint>"))


# -- maps


def map_get(m: Column, key) -> Column:
    """The value; a missing key is an error."""
    return F.coalesce(F.element_at(m, key), F.when(F.array_contains(F.map_keys(m), key), F.lit(None)).otherwise(F.raise_error(F.lit(f"no key {key}"))))


def map_length(m: Column) -> Column:
    return F.size(m).cast("long")


def map_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))


def map_of(entries: Column) -> Column:
    return F.map_from_entries(entries)


def is_none(x: Column, kind: str = "scalar") -> Column:
    """Null, or an empty tuple or map."""
    return x.isNull() if kind == "scalar" else x.isNull() | (F.size(x) == 0)
