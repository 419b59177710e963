"""Strings and other values: templates, casts, identifiers, hashes, parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EMAIL, LINK, concrete, spark_type


def render(template: str, params: dict[str, Column]) -> Column:
    """A template whose {{name}} are replaced by columns ({{{name}}} too); an unknown name becomes empty."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{\{?\s*([\w.]+)\s*\}?\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(params[m[1]].cast("string"), F.lit("")) if m[1] in params else F.lit(""))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def render_column(template: Column, params: dict[str, Column]) -> Column:
    """The same for templates that are data."""
    for name, value in params.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def cast(x: Column, dtype: str) -> Column:
    """A value that can't be cast is an error."""
    return version(x) if concrete(dtype) == "version" else x.cast(spark_type(dtype))


def try_cast(x: Column, dtype: str) -> Column:
    return x.try_cast(spark_type(dtype))


def equal(a: Column, b: Column) -> Column:
    """Of values of any kind; none equals none."""
    return a.eqNullSafe(b)


def uuid() -> Column:
    return F.uuid()


def uuid_bytes(x: Column) -> Column:
    return F.unhex(F.replace(x, F.lit("-"), F.lit("")))


def version(x: Column) -> Column:
    """major.minor.rev as numbers, which order as versions do."""
    parts = F.split(x, r"\.")
    return F.struct(*[F.element_at(parts, i + 1).cast("long").alias(n) for i, n in enumerate(("major", "minor", "rev"))])


def is_email(x: Column) -> Column:
    return x.rlike(EMAIL)


def is_link(x: Column) -> Column:
    return x.rlike(LINK)


def link_parts(x: Column) -> Column:
    get = lambda part: F.parse_url(x, F.lit(part))
    return F.struct(get("PROTOCOL").alias("protocol"), get("HOST").alias("host"), get("PATH").alias("path"))


def class_of(x) -> str:
    """The class path of a value, table, set, tensor, column or operation."""
    kind = type(x).__name__
    if isinstance(x, bool):
        return "scalar/value/number/bool"
    if x is None:
        return "scalar/value/none"
    for t, path in ((int, "scalar/value/number/int/64"), (float, "scalar/value/number/float/64"), (complex, "scalar/value/number/complex/64"), (str, "scalar/value/string"), (bytes, "scalar/value/bytes"), (tuple, "scalar/tuple"), (list, "scalar/tuple"), (dict, "scalar/map")):
        if isinstance(x, t):
            return path
    if kind == "Tensor":
        return "collection/tensor/" + ("sparse" if x.sparse else "dense")
    return {"Table": "collection/table", "OrderedSet": "collection/btree", "Op": "scalar/op", "Store": "chain", "Column": "scalar/ref"}.get(kind, "object/" + kind)


def state_hash(df: DataFrame) -> DataFrame:
    """SHA-256 over all rows whatever their order: row hashes are folded by addition in fixed chunks, then hashed.

    A sorted list of all row hashes would meet in one task; sums of their eight 32-bit words are combined map-side.
    """
    row = F.sha2(F.encode(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), "UTF-8"), 256)
    words = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"w{i}") for i in range(8)]
    sums = df.agg(F.count("*").alias("n"), *words)
    text = F.concat_ws(":", F.col("n").cast("string"), *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(8)])
    return sums.select("n", F.sha2(F.encode(text, "UTF-8"), 256).alias("hash"))
