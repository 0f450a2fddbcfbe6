"""Catalog: filters, distinct lists, counts and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmill.functions.text import content_hash, shortened
from contentmill.operators.matching import fuzzy_anti, unseen


def same_text(column: str, value: str) -> Column:
    """Equal but for case; the value is no pattern."""
    return F.lower(F.col(column)) == value.lower()


def where_given(df: DataFrame, equal: Mapping[str, object] | None = None, same: Mapping[str, str] | None = None, among: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Filters whose argument is given; None, empty strings and empty lists filter nothing."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v) if v else df
    for c, v in (same or {}).items():
        df = df.where(same_text(c, v)) if v else df
    for c, v in (among or {}).items():
        df = df.where(F.col(c).isin(list(v))) if v else df
    return df


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def distinct_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def names_to_generate(books: DataFrame, bank: DataFrame, name: str) -> DataFrame:
    """Names of the books, and those of the bank that no book covers, sorted."""
    return books.select(name).union(fuzzy_anti(bank.select(name).distinct(), name, books, name)).distinct().orderBy(name)


def first_seen(sources: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str]) -> DataFrame:
    """Distinct keys in the order in which they first appear, source after source.

    Each source comes with the columns that order it. Adds ``tier`` and ``place``, by
    which the result is sorted; only first places are shuffled.
    """
    widest = max(len(order) for _, order in sources)
    out = seen = None
    for tier, (df, order) in enumerate(sources):
        found = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])).alias("_first"))
        if seen is not None:
            found = unseen(found, seen, keys)
        places = [F.col(f"_first.o{i}") if i < len(order) else F.lit(None).cast("long").alias(f"o{i}") for i in range(widest)]
        part = found.select(*keys, F.lit(tier).alias("tier"), *places)
        out = part if out is None else out.unionByName(part)
        seen = df.select(*keys) if seen is None else seen.union(df.select(*keys))
    return out.orderBy("tier", *[f"o{i}" for i in range(widest)]).select(*keys, "tier")


def counts_if(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(*[F.count_if(c).cast("long").alias(name) for name, c in conditions.items()])


def grouped_lists(df: DataFrame, by: str, order: str, item: str) -> DataFrame:
    """Each group's count and its items in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item])
    return df.groupBy(by).agg(F.count("*").alias("n"), listed.alias("items"))


def file_report(rows: DataFrame, failures: DataFrame, errors: DataFrame, file: str) -> DataFrame:
    """For each file the parsed rows, failures and fatal error; a bad file is a row like others."""
    ok = rows.groupBy(file).agg(F.count("*").alias("ok"))
    bad = failures.groupBy(file).agg(F.count("*").alias("failed"))
    fatal = errors.groupBy(file).agg(F.min("error").alias("error"))
    return ok.join(bad, file, "full").join(fatal, file, "full").select(file, F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("failed", F.lit(0)).alias("failed"), "error")


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def distinct_content(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row for each content hash, the one of the lowest ``order``, with ``content_hash``."""
    hashed = df.withColumn("content_hash", content_hash(F.col(text)))
    return hashed.groupBy("content_hash").agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*", "content_hash")


def listing(df: DataFrame, order: Sequence[str | Column], *, short: Mapping[str, int] | None = None, sizes: Mapping[str, str] | None = None) -> DataFrame:
    """A sorted listing: long texts shortened, or replaced by their length (null counts as empty)."""
    for c, n in (short or {}).items():
        df = df.withColumn(c, shortened(F.col(c), n))
    for c, size in (sizes or {}).items():
        df = df.withColumn(size, F.length(F.coalesce(c, F.lit("")))).drop(c)
    return df.orderBy(*order)


def newest_block(df: DataFrame, by: Sequence[str], order: str, text: str, *, limit: int = 8, size: int = 300) -> DataFrame:
    """For each group the texts of the newest rows as ``- `` lines, newest first."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_rank") <= limit)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.concat(F.lit("- "), F.substring(text, 1, size)).alias("line")))), lambda x: x["line"])
    return ranked.groupBy(*by).agg(F.array_join(lines, "\n").alias("block"))


def preview(df: DataFrame, position: str, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first rows in input order, and the full count."""
    return df.orderBy(position).limit(limit), df.agg(F.count("*").alias("n"))
