"""Sharding by proportional stratified interleaving.

Rows of each stratum are ranked in a seeded order, all rows are sorted by their fractional rank
(rank + 1/2) / size of the stratum, and the sorted sequence is cut into runs of equal counts, so that every shard
holds each stratum in proportion. Both rankings are distributed: rows are range-partitioned by their full sort key
(so a hot stratum spreads over many tasks), in ranges of about ``RANGE`` rows however many there are, take their places
inside each range from the sorted scan, and are shifted by the counts of the ranges before.

Only the narrow rows given are moved; a text column is better joined on afterwards. The seeded order is that of an MD5
of the seed and the ``order`` columns, so any SQL engine can repeat it.

The law is ``rows``: counts of shards differ by one at most. Rows of equal text (the contract's groups) are rows like any
other and may come to unlike shards; it is the places that are equal in number, not the bytes.

Defined results: slots are gapless from 0; with fewer rows than shards the excess shards stay empty. Nulls are a
stratum of their own, and ordinary keys. Rows alike in ``order`` and stratum are interchangeable; they take
neighbouring places, and which of them takes which may differ between runs. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, col, written

#: Rows of a sorted range that one task holds.
RANGE = 1_000_000


def numbered(df: DataFrame, by: list, group: str | None, name: str) -> DataFrame:
    """Add ``name``: the place of each row (from 0) in the order ``by`` within ``group`` (within all, if None).

    ``group`` must lead the order. What meets in one task is a row for each range (for each range that holds a part
    of one group, if there is one). ``df`` should be written or cheap to read: it is counted, sampled and sorted.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__no", F.monotonically_increasing_id())
    kept = written(ranged, "shard")  # the sampled bounds are fixed by what is written
    part = F.shiftrightunsigned("__no", 33)
    kept = kept.withColumn("__part", part).withColumn("__no", F.col("__no") - F.shiftleft(part, 33))
    keys = ["__part"] + ([group] if group else [])
    counts = kept.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__no").alias("__first"))
    window = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("__part")
    counts = counts.withColumn("__shift", F.sum("__n").over(window) - F.col("__n") - F.col("__first"))
    counts = written(counts.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__shift"), "shift")
    small = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    match = F.col("__part") == F.col("__k0")
    if group:
        match &= col(group).eqNullSafe(F.col("__k1"))
    return kept.join(F.broadcast(counts) if small else counts, match).withColumn(name, F.col("__no") + F.col("__shift")).select(*[col(c) for c in df.columns], name)


def seeded(seed: int, columns: list[str]):
    """60 bits of the MD5 of seed:value:value..., nulls as nothing."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def assign(df: DataFrame, shards: int, stratum: str = "source", order: list[str] | None = None, seed: int = 5) -> DataFrame:
    """The rows with ``shard int`` and ``slot long``. ``order``: columns that tell rows apart; they seed the shuffle."""
    order = order or ["doc_id"]
    rows = df.drop("shard", "slot", "__g", "__h").withColumn("__g", F.coalesce(F.concat(F.lit("="), col(stratum).cast("string")), F.lit("")))
    rows = written(rows.withColumn("__h", seeded(seed, order)), "narrow")
    ranked = numbered(rows, [F.col("__g"), F.col("__h"), *[col(c) for c in order]], "__g", "__rank")
    sizes = rows.groupBy("__g").agg(F.count("*").alias("__size"))
    sizes = written(sizes.withColumnRenamed("__g", "__s"), "strata")
    small = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    total = sizes.agg(F.sum("__size")).first()[0] or 0
    placed = ranked.join(F.broadcast(sizes) if small else sizes, F.col("__g") == F.col("__s")).withColumn("__f", (2 * F.col("__rank") + 1).cast("double") / (2 * F.col("__size")))
    placed = numbered(placed.drop("__s", "__size", "__rank"), [F.col("__f"), F.col("__g"), F.col("__h"), *[col(c) for c in order]], None, "__at")
    shard = F.expr(f"CAST(__at * {shards} DIV {max(1, total)} AS INT)")
    first = F.expr(f"(shard * {max(1, total)}L + {shards - 1}) DIV {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("__at") - first).cast("long")).drop("__f", "__g", "__h", "__at")
