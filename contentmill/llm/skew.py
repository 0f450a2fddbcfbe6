"""Joins in which a few keys may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this.
HOT_SHARE = 1000


def join_hot(many: DataFrame, few: DataFrame, keys: Sequence[str], rows: str, how: str = "inner", totals: tuple[int, int] | None = None) -> DataFrame:
    """``many`` joined with ``few`` on ``keys`` (one row of ``few`` for each), left or inner.

    ``few`` counts in ``rows`` how many rows of ``many`` have its key. Hot keys, fewer than
    ``HOT_SHARE`` by their definition, are broadcast, and their rows stay where they are;
    the others are shuffled, and no task gets more than its part of them. ``totals``: sum
    and maximum of ``rows``, if known.
    """
    total, most = totals or few.agg(F.sum(rows), F.max(rows)).first()
    if not total or most * HOT_SHARE <= total:
        return many.join(few, list(keys), how)
    hot = few.where(F.col(rows) * HOT_SHARE > total)
    at_once = many.join(F.broadcast(hot), list(keys))
    rest = many.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(few.where(F.col(rows) * HOT_SHARE <= total), list(keys), how)
    return at_once.unionByName(rest)
