"""Whitening of embeddings by a distributed singular value decomposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentmill.llm.scaled import scaled_rows
from contentmill.llm.workspace import Workspace

#: Singular values below this part of the largest count as zero: their squares lie within
#: 1e-11 of the largest eigenvalue, where doubles no longer carry four digits of them.
SMALLEST = 3e-6


def _column_sums(frames):
    """Frames of ``x`` -> one row with the number of rows and the exact sum of each dimension."""
    n, total = 0, None
    for f in frames:
        if len(f):
            x = np.stack(f["x"].to_numpy())
            n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
    if n:
        yield pd.DataFrame({"n": [n], "total": [total]})


def _project(shared):
    def run(frames):
        to = shared.value
        for f in frames:
            if len(f):
                f["whitened"] = list(np.stack(f.pop("centred").to_numpy()) @ to)
                yield f

    return run


def row_matrix(rows: DataFrame, column: str, n: int, dim: int) -> RowMatrix:
    """The array column as a distributed matrix; rows stay in the JVM."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("row")), "row"), n, dim)


def _array(values: list[int], kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, offset: int = 1_000_000) -> DataFrame:
    """Whitened coordinates of vectors, one row per vector and component.

    Columns: the id, ``component`` (from 1, by falling variance), ``n`` (vectors of the fit),
    ``deviation`` (squared distance from the mean times n^2, exact), ``whitened``,
    ``explained`` (the component's part of all variance) and ``identity_error`` (largest
    entry by which the covariance of all whitened vectors misses the identity).

    Components x become whole numbers floor(64 * x) + ``offset``, and their sums S are
    exact. Rows are centred as (n * x - S) / n, so that one division is all that rounds
    and a large mean costs no digits. MLlib's ``computeSVD`` of the centred distributed
    rows gives singular values s and directions; eigenvalues are s^2 / n. The variance of
    all dimensions is summed from the deviations apart from it. To the driver come a row
    of sums for each dimension and two matrices of the vectors' length a side.

    Vectors that are null or hold null or non-finite components are left out. Vectors of
    different lengths can't be projected together: those of the commonest length (of
    equally common ones the longest) are taken, and others have no rows. Directions without
    variance (``SMALLEST``) are no components, so equal vectors, a single one and an empty
    table give no rows. Rows that repeat an id or a vector count each for themselves, null
    ids are kept. ``deviation`` is null where it doesn't fit a long. Components beyond
    +-2^21 raise an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "whitening")
    points = ws.table(scaled_rows(vectors, id_col, vector_col, offset).withColumn("dim", F.size("v")).select("id", F.col("v").alias("x"), "dim"), "points")
    kind = points.schema["id"].dataType.simpleString()
    out = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = points.where("dim > 0").groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], out)
    dim, n = common["dim"], common["n"]
    points = points.where(F.col("dim") == dim)

    parts = points.select("x").mapInPandas(_column_sums, "n long, total array<long>").select(F.posexplode("total").alias("d", "total"))
    sums = {r["d"]: int(r["total"]) for r in parts.groupBy("d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    # n * x - S = n * (x - S div n) - S mod n, which stays small however large the mean is.
    floors, rests = _array([sums[d] // n for d in range(dim)], "bigint"), _array([sums[d] % n for d in range(dim)], "bigint")
    apart = F.zip_with(F.zip_with("x", floors, lambda x, m: (x - m) * F.lit(n).cast("bigint")), rests, lambda x, r: x - r)
    rows = points.select("id", apart.alias("apart"))
    exact = F.coalesce(
        F.expr("cast(aggregate(apart, 0L, (a, d) -> try_add(a, try_multiply(d, d))) as decimal(38,0))"),
        F.expr("aggregate(apart, cast(0 as decimal(38,0)), (a, d) -> cast(a + cast(d as decimal(19,0)) * cast(d as decimal(19,0)) as decimal(38,0)))"),
    )
    total = float(rows.select(F.sum(exact.cast("double"))).first()[0])  # n^3 times the trace of the covariance
    if not total:
        return spark.createDataFrame([], out)
    centred = rows.select("id", exact.alias("deviation"), F.transform("apart", lambda d: d.cast("double") / F.lit(float(n))).alias("centred"))
    found = row_matrix(centred, "centred", n, dim).computeSVD(min(components, dim), False, SMALLEST)
    eigenvalues = found.s.toArray() ** 2 / n
    model = spark.sparkContext.broadcast(found.V.toArray() / np.sqrt(eigenvalues)[None, :])
    given = centred.select("id", F.expr("try_cast(deviation as bigint)").alias("deviation"), "centred")
    scores = ws.table(given.mapInPandas(_project(model), f"id {kind}, deviation long, whitened array<double>"), "scores")
    ws.drop("points")
    # computeCovariance centres before it multiplies, and divides by n - 1.
    covariance = row_matrix(scores, "whitened", n, len(eigenvalues)).computeCovariance().toArray() * ((n - 1) / n)
    error = float(np.abs(covariance - np.eye(len(eigenvalues))).max())
    explained = F.array(*[F.lit(float(e) * n**3 / total) for e in eigenvalues])
    by_component = scores.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return by_component.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
