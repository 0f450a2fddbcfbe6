"""Vectors as whole numbers, for work that must be exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers stay below this, so that squared distances of 64 components fit a long.
LIMIT = 1 << 27


def scaled_rows(vectors: DataFrame, id_col: str, vector_col: str, offset: int = 0) -> DataFrame:
    """``id`` and ``v``, floor(64 * x) + ``offset`` as long for each component x as double.

    Rows whose vector is null or holds null or non-finite components are left out. A
    component beyond +-2^21 (``LIMIT`` when scaled) ends the job with an error that names
    it, rather than overflow into a wrong result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = rows.where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    whole = lambda x: F.when(F.abs(x) < LIMIT / 64, F.floor(x * 64) + F.lit(offset)).otherwise(F.raise_error(F.concat(F.lit("component out of range: "), x.cast("string"))).cast("bigint"))
    return finite.select("id", F.transform("v", whole).alias("v"))
