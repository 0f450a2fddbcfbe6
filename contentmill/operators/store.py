"""Changes to stored tables, as functions from tables to tables.

Plain files can't be merged in place: each function returns the new rows or table, and
``sources.files.replace_table`` writes a new version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentmill.functions.naming import subject_name
from contentmill.functions.text import needs_image
from contentmill.operators.draws import numbered

DECISIONS = ("aprovada", "rejeitada")
CURATED_ORIGINS = ("banco_real", "simulado_migrado")


class Conflict(ValueError):
    """A row to insert has the key of a stored one."""


class BadDecision(ValueError):
    """A review decision that isn't one of ``DECISIONS``."""


class Missing(LookupError):
    """No row has the id."""


def new_rows(new: DataFrame, stored: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows to append: the first of each key by ``order`` that isn't stored; stored rows win."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return first.join(stored.select(*keys), list(keys), "left_anti")


def upsert_counts(new: DataFrame, inserted: DataFrame) -> DataFrame:
    total = new.agg(F.count("*").alias("total"))
    done = inserted.agg(F.count("*").alias("inserted"))
    return total.join(done, F.lit(True)).select("inserted", (F.col("total") - F.col("inserted")).alias("duplicates"))


def insert_strict(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` if none of its keys is stored or repeats, else ``Conflict``."""
    clash = new.groupBy(*keys).count().where("count > 1").select(*keys).union(new.join(stored.select(*keys), list(keys), "left_semi").select(*keys))
    if not clash.isEmpty():
        raise Conflict(f"key {tuple(keys)} is stored already")
    return new


def update_by_key(stored: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str | Column | None = None) -> DataFrame:
    """``stored`` with ``columns`` taken from the change of the same key, and ``matched``. A null overwrites.

    Of changes of one key the last by ``order`` counts; without one, the last as they are read.
    """
    last = F.monotonically_increasing_id() if order is None else F.col(order) if isinstance(order, str) else order
    new = changes.select(*keys, F.struct(*columns).alias("_new"), last.alias("_order")).groupBy(*keys).agg(F.max_by("_new", "_order").alias("_new"))
    joined = stored.join(new, list(keys), "left")
    hit = F.col("_new").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).withColumn("matched", hit).drop("_new")


def match_counts(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = changes.join(stored.select(*keys).distinct().withColumn("_hit", F.lit(1)), list(keys), "left")
    return found.agg(F.count_if(F.col("_hit").isNotNull()).alias("updated"), F.count_if(F.col("_hit").isNull()).alias("missing"))


def delete_returning(stored: DataFrame, ids: DataFrame, key: str, *, only: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept rows and deleted ones; rows that don't meet ``only`` are never deleted."""
    allowed = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    marked = stored.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    gone = F.coalesce("_gone", F.lit(False)) & allowed
    return marked.where(~gone).drop("_gone").select(stored.columns), marked.where(gone).drop("_gone").select(stored.columns)


def delete_curated(stored: DataFrame, ids: DataFrame, key: str = "id", origin: str = "origem") -> tuple[DataFrame, DataFrame]:
    return delete_returning(stored, ids, key, only=F.col(origin).isin(*CURATED_ORIGINS))


def append_use(stored: DataFrame, picked: DataFrame, key: str, used: str, at: Column) -> DataFrame:
    """Each picked row gets ``at`` once more at the end of its array of uses."""
    marked = stored.join(picked.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn(used, F.when(F.col("_hit"), F.array_append(F.coalesce(F.col(used), F.array().cast("array<timestamp>")), at)).otherwise(F.col(used))).drop("_hit").select(stored.columns)


def review(stored: DataFrame, decisions: DataFrame, *, key: str = "id", at: Column | None = None) -> DataFrame:
    """Reviewed rows: status, reviewer, time; the reason only of rejections.

    ``decisions`` has the key, ``decision``, ``reviewer`` and ``reason``. A decision that
    isn't known raises ``BadDecision``, an id that isn't stored ``Missing``. Rows may be
    reviewed again.
    """
    if not decisions.where(F.col("decision").isNull() | ~F.col("decision").isin(*DECISIONS)).isEmpty():
        raise BadDecision(f"a decision is one of {DECISIONS}")
    if not decisions.join(stored.select(key), key, "left_anti").isEmpty():
        raise Missing("an id isn't stored")
    return apply_reviews(stored, decisions, key=key, at=F.current_timestamp() if at is None else at)


def apply_reviews(stored: DataFrame, decisions: DataFrame, *, key: str, at: Column) -> DataFrame:
    new = decisions.select(key, F.struct("decision", "reviewer", "reason").alias("_d"))
    hit = F.col("_d").isNotNull()
    changed = {
        "status": F.when(hit, F.col("_d.decision")).otherwise(F.col("status")),
        "revisado_por": F.when(hit, F.col("_d.reviewer")).otherwise(F.col("revisado_por")),
        "revisado_em": F.when(hit, at).otherwise(F.col("revisado_em")),
        "motivo_rejeicao": F.when(hit, F.when(F.col("_d.decision") == "rejeitada", F.col("_d.reason"))).otherwise(F.col("motivo_rejeicao")),
    }
    return stored.join(new, key, "left").withColumns(changed).drop("_d").select(stored.columns)


def prepare_curated(rows: DataFrame) -> DataFrame:
    """Subject in its one name; status from whether the stem needs an image."""
    return rows.withColumn("materia", subject_name(F.col("materia"))).withColumn("status", F.when(needs_image(F.col("enunciado")), "pendente_revisao").otherwise("aprovada"))


def invalid_rows(df: DataFrame, required: Sequence[str], allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Rows that break a not-null or an enumeration rule, with ``broken`` (the rules' columns)."""
    rules = [F.when(F.col(c).isNull(), F.lit(c)) for c in required] + [F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(v)), F.lit(c)) for c, v in allowed.items()]
    return df.withColumn("broken", F.array_compact(F.array(*rules))).where(F.size("broken") > 0)


def next_ids(stored: DataFrame, rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """``rows`` with ids that follow the highest stored one, in ``order``, without gaps."""
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_top"))
    return numbered(rows, order, "_n").join(F.broadcast(top), F.lit(True)).withColumn(key, F.col("_top") + F.col("_n")).drop("_n", "_top")
