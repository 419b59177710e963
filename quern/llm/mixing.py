"""Mixing sources to target weights, with DataFrame functions only.

Sizes are added up per source; the sources' targets follow from their weights and the cap; each source's rate is
its target over its size. A document is emitted floor(rate) times, and once more if a number drawn from a hash of
(seed, key, text, occurrence) lies under the rate's fraction.

Targets: the sources share all words by weight; a target stops at ``cap`` times its source's size, and the excess
goes to the others by weight until none is above. The level rises in rounds, each one sum over the sources; weights
go by the sources' ranks, taken in sorted ranges of ``RANKED`` sources. So no task holds all sources, however many.

Occurrences number the rows that are alike in source, key and text, so that rows of a null or repeated key draw
each for itself. Only such rows are looked at again: a 64-bit hash finds them (a collision costs work, no more). A
group's rows are numbered in ``SALTS`` parts, shifted by the parts before, so that a hot group is no hot task;
which of some like rows has which number is of no consequence.

Defined results: null text has size 0 and draws like an empty one; null sources are one source, last in order; a null
key draws like an empty one; a source of size 0 has rate 0. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, join_small, written

#: Words as maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Names of the columns that the steps add.
OWN = ("size", "source_size", "target", "taken", "copies", "__source", "__key", "__print", "__rate", "__of", "__occurrence")
#: Sources that one task ranks, and parts in which like rows are numbered.
RANKED = 100_000
SALTS = 64


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Columns kept (all, if None) with ``size``, ``__source``, ``__key`` and ``__print``; a kept column of a result's name goes."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in OWN]
    alike = F.md5(F.encode(F.coalesce(col(text), F.lit("")), "UTF-8"))
    return df.select(*[col(c) for c in kept], words(text).alias("size"), col(source).alias("__source"), F.coalesce(col(key).cast("string"), F.lit("")).alias("__key"), alike.alias("__print"))


def shifted(rows: DataFrame, keys: list[str], part: str, n: str) -> DataFrame:
    """(keys, part, __before): the sum of ``n`` over the parts before, for each of ``keys``; a row for each part."""
    before = Window.partitionBy(*keys).orderBy(part) if keys else Window.partitionBy(F.lit(0)).orderBy(part)
    return rows.select(*keys, part, (F.sum(n).over(before) - F.col(n)).alias("__before"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(__source, source_size, target) from rows with __source and size."""
    s = written(sizes.groupBy("__source").agg(F.sum("size").alias("source_size")), "sources")
    by = F.encode("__source", "UTF-8").asc_nulls_last()
    ranges = s.repartitionByRange(-(-s.count() // RANKED) or 1, by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id())
    ranges = written(ranges, "ranges").withColumn("__part", F.shiftrightunsigned("__at", 33))  # the bounds are fixed by what is written
    before = shifted(ranges.groupBy("__part").agg(F.count("*").alias("__n")), [], "__part", "__n")
    rank = F.col("__at") - F.shiftleft("__part", 33) + F.col("__before")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = written(ranges.join(F.broadcast(before), "__part").select("__source", "source_size", weight.alias("w")), "weights")
    total, every = (x or 0 for x in s.agg(F.sum("source_size"), F.sum("w")).first())
    rest, left = total, every
    while left:
        wide = F.col("source_size").cast("decimal(20,0)") * F.lit(cap * left).cast("decimal(18,0)")
        full = wide < F.col("w").cast("decimal(10,0)") * F.lit(rest).cast("decimal(20,0)")
        held = [x or 0 for x in s.where(full).agg(F.sum("source_size"), F.sum("w")).first()]
        if (total - cap * held[0], every - held[1]) == (rest, left):
            break
        rest, left = total - cap * held[0], every - held[1]
    level = (F.col("w") * F.lit(rest)).cast("double") / F.lit(left) if left else F.lit(None).cast("double")
    most = (cap * F.col("source_size")).cast("double")
    return s.select("__source", "source_size", (F.when(full, most).otherwise(level) if left else most).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed:key; any SQL engine can repeat it."""
    text = F.concat(F.lit(f"{seed}:"), key)
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def like(rows: DataFrame) -> DataFrame:
    """The hashes of (source, key, text) that more than one row has; written."""
    h = rows.select(F.xxhash64("__source", "__key", "__print").alias("__h"))
    return written(h.groupBy("__h").agg(F.count("*").alias("n")).where("n > 1").select("__h"), "like")


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``__occurrence``, from 1, among those alike in source, key and text."""
    again = like(rows)
    if again.isEmpty():
        return rows.withColumn("__occurrence", F.lit(1).cast("long"))
    hashed = rows.withColumn("__h", F.xxhash64("__source", "__key", "__print"))
    again = again.withColumn("__again", F.lit(True))
    marked = join_small(hashed, again, "__h").drop("__h")
    group = ["__source", "__key", "__print"]
    # numbers depend on how rows come to tasks; written, they hold
    some = written(marked.where("__again").drop("__again").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "alike")
    parts = shifted(some.groupBy(*group, "__salt").agg(F.count("*").alias("__n")), group, "__salt", "__n")
    parts = parts.select(*[F.col(c).alias(f"{c}_of") for c in group], F.col("__salt").alias("__salt_of"), "__before")
    at = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in group] + [F.col("__salt") == F.col("__salt_of")]
    some = some.withColumn("__at", at).join(parts, on).withColumn("__occurrence", F.col("__at") + F.col("__before"))
    alone = marked.where("__again IS NULL").drop("__again").withColumn("__occurrence", F.lit(1).cast("long"))
    return alone.unionByName(some.select(alone.columns))


def rated(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20) -> DataFrame:
    """Rows of ``sized`` with source_size, target and ``copies``.

    The sources' table is written, counted, and broadcast if small; else both sides shuffle on the source, and
    adaptive execution splits a hot one.
    """
    by = written(targets(rows.select("__source", "size"), weights, cap), "mix")
    by = by.withColumnRenamed("__source", "__of")
    small = by.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = numbered(rows).join(F.broadcast(by) if small else by, F.col("__source").eqNullSafe(F.col("__of")))
    rate = F.when(F.col("source_size") > 0, F.try_divide(F.col("target"), F.col("source_size"))).otherwise(F.lit(0.0))
    out = out.withColumn("__rate", rate)
    drawn = draw(F.concat_ws(":", "__key", "__print", F.col("__occurrence").cast("string")), seed)
    extra = F.when(drawn < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return out.withColumn("copies", (F.floor("__rate") + extra).cast("int")).drop("__rate", "__of", "__occurrence")


def taken(rows: DataFrame, **how) -> DataFrame:
    """What the mix takes of each row of ``sized``: kept columns, size, source_size, target, taken. Narrow rows are written first."""
    return rated(written(rows, "sized"), **how).withColumn("taken", F.col("size") * F.col("copies")).drop("__source", "__key", "__print", "copies")


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mixed corpus: each row ``copies`` times, with the columns of ``df``."""
    whole = df.select(F.struct(*[col(c) for c in df.columns]).alias("__row"), col(text).alias("__text"), col(source).alias("__from"), col(key).alias("__id"))
    rows = rated(sized(whole, "__text", "__from", "__id", keep=["__row"]), **how)
    copy = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))
    return rows.select("__row", copy.alias("__copy")).select("__row.*")
