"""Stock draws and orders: reuse priority, stratified draws, round robin, boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ShortStock(ValueError):
    """A draw asks for more than there is."""


def reuse_order(used: str, key: str) -> list[Column]:
    """Never used first, then the fewest uses, the oldest last use, the key."""
    return [F.size(F.coalesce(F.col(used), F.array())).asc(), F.array_max(used).asc_nulls_first(), F.col(key).asc()]


def candidates(df: DataFrame, used: str, key: str) -> DataFrame:
    return df.orderBy(*reuse_order(used, key))


def draw(df: DataFrame, quantity: int, used: str, key: str) -> DataFrame:
    """The first ``quantity`` rows by reuse priority, or ``ShortStock``; nothing is changed."""
    have = df.limit(quantity).count()  # a limit reads no more than it needs
    if have < quantity:
        raise ShortStock(f"{quantity} asked for, {have} in stock")
    return df.orderBy(*reuse_order(used, key)).limit(quantity)


def shortages(df: DataFrame, quotas: DataFrame, stratum: str) -> DataFrame:
    """Strata of ``quotas`` (stratum, quantity) with less stock than asked for."""
    have = df.groupBy(stratum).agg(F.count("*").alias("available"))
    return quotas.join(have, stratum, "left").select(stratum, "quantity", F.coalesce("available", F.lit(0)).alias("available")).where("available < quantity")


def draw_stratified(df: DataFrame, quotas: DataFrame, stratum: str, used: str, key: str, *, largest: int | None = None) -> DataFrame:
    """For each stratum its quota of rows by reuse priority; no rows at all if any is short.

    ``quotas`` has the stratum, ``quantity`` and ``position`` (the order of strata). Adds
    ``rank`` within the stratum. ``largest`` (no quota exceeds it) lets Spark drop rows
    before the shuffle that ranks them. The stock is read once: strata are short if fewer
    rows than asked for were ranked.
    """
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*reuse_order(used, key)))
    ranked = df.join(quotas, stratum).withColumn("rank", rank)
    if largest is not None:
        ranked = ranked.where(F.col("rank") <= largest)
    taken = ranked.where(F.col("rank") <= F.col("quantity"))
    asked = quotas.agg(F.sum("quantity").alias("_asked"))
    # What is drawn is as small as the quotas; a window over it counts what there is.
    counted = taken.withColumn("_drawn", F.count("*").over(Window.partitionBy(F.lit(1))))
    return counted.join(F.broadcast(asked), F.col("_drawn") == F.col("_asked")).drop("_drawn", "_asked").orderBy("position", "rank")


def numbered(df: DataFrame, order: str, out: str, *, piece: int = 100_000) -> DataFrame:
    """Rows numbered from 1 by ``order`` (values that don't repeat), no task numbering many more than ``piece``.

    Rows are dealt to stretches of the order, between values that a hash picks; a stretch
    is numbered by itself, from where the counts of those before it end.
    """
    total = df.count()
    pieces = min(1024, -(-total // piece))
    borders = []
    if pieces > 1:
        every = max(1, total // (32 * pieces))
        picked = [r[0] for r in df.where(F.pmod(F.xxhash64(order, F.lit(5)), F.lit(every)) == 0).select(order).orderBy(order).collect()]
        borders = picked[:: max(1, len(picked) // pieces)][1:]
    kind = df.schema[order].dataType
    stretch = F.size(F.filter(F.lit(borders).cast(f"array<{kind.simpleString()}>"), lambda b: b <= F.col(order))) if borders else F.lit(0)
    dealt = df.withColumn("_stretch", stretch)
    sizes, starts, at = {r[0]: r[1] for r in dealt.groupBy("_stretch").count().collect()}, [], 0
    for i in range(len(borders) + 1):
        starts.append(at)
        at += sizes.get(i, 0)
    number = F.row_number().over(Window.partitionBy("_stretch").orderBy(order)) + F.element_at(F.lit(starts).cast("array<long>"), F.col("_stretch") + 1)
    return dealt.withColumn(out, number.cast("long")).drop("_stretch")


def round_robin(items: DataFrame, order: str, quantity: int) -> DataFrame:
    """``quantity`` rows: place i gets the item of rank i modulo the number of items."""
    first = items.orderBy(order).limit(quantity)  # no more are ever used
    listed = first.select(F.row_number().over(Window.orderBy(order)).alias("_r"), "*").join(F.broadcast(items.agg(F.count("*").alias("_n"))), F.lit(True))
    turns = F.sequence(F.col("_r") - 1, F.lit(quantity - 1), F.col("_n").cast("int"))
    return listed.withColumn("i", F.explode(turns)).drop("_r", "_n")


def newest(df: DataFrame, key: str, limit: int = 8) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(limit)


def any_one(df: DataFrame, key: str) -> DataFrame:
    """One row; the lowest key, so that it is always the same."""
    return df.orderBy(key).limit(1)


def any_by_seed(df: DataFrame, key: str, seed: int, limit: int = 1) -> DataFrame:
    """Rows picked by a hash of the key and a seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(limit)


def with_next_start(df: DataFrame, by: Sequence[str], start: str, end_of_text: str, *, out: str = "end") -> DataFrame:
    """Adds where the next segment starts, or the end of the text."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), F.col(end_of_text)))


def with_previous_end(df: DataFrame, by: Sequence[str], order: str, end: str, *, out: str = "begin") -> DataFrame:
    """Adds where the previous segment ended, or 0."""
    return df.withColumn(out, F.lag(end, 1, 0).over(Window.partitionBy(*by).orderBy(order)))


def with_offsets(df: DataFrame, by: Sequence[str], order: str, text: str, *, separator: int = 1, out: str = "offset") -> DataFrame:
    """Adds the start of each part within the parts joined by a separator of this length."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(F.length(F.coalesce(text, F.lit(""))) + separator).over(before), F.lit(0)))


def last_in_group(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def nearest_in_group(df: DataFrame, by: Sequence[str], distance: Column, position: str) -> DataFrame:
    """The row of the least distance; ties go to the lowest position."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(distance, F.col(position))).alias("r")).select(*by, "r.*")
