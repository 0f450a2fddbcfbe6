"""Centroid clustering: Lloyd's rounds over whole-number vectors, exact at every step."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmill.llm.scaled import scaled_rows
from contentmill.llm.workspace import Workspace


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first among equals, and its squared distance."""
    squared = np.empty((len(x), len(centroids)), dtype=np.int64)
    for j, centroid in enumerate(centroids):
        apart = x - centroid
        np.einsum("ij,ij->i", apart, apart, out=squared[:, j])
    near = squared.argmin(axis=1)
    return near, squared[np.arange(len(x)), near]


def _partition_sums(shared):
    """Frames of ``v`` -> for each centroid, the number and componentwise sum of the partition's rows nearest to it."""

    def run(frames):
        centroids = shared.value
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                near, _ = nearest(x, centroids)
                for j in np.unique(near):
                    mine = x[near == j]
                    count[j] += len(mine)
                    total[j] += mine.sum(axis=0)
        used = np.flatnonzero(count)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], "total": list(total[used])})

    return run


def _assign(shared):
    def run(frames):
        for f in frames:
            if len(f):
                near, squared = nearest(np.stack(f["v"].to_numpy()), shared.value)
                yield pd.DataFrame({"id": f["id"], "cluster": near.astype(np.int32), "distance": squared})

    return run


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's rows, and empty ones as they are."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    parts = points.select("v").mapInPandas(_partition_sums(shared), "cluster int, n long, total array<long>")
    wide = parts.select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("total").alias("d", "total"))
    # One row for each centroid and dimension, however many rows there are.
    sums = wide.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["d"]] = int(r["total"]) // int(r["n"])
    shared.unpersist()
    return out


def centroid_clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """Clusters of vectors of ``dim`` components by plain Lloyd rounds, one row per kept vector.

    Columns: the id, ``cluster``, ``distance`` (squared, of whole numbers),
    ``cluster_inertia`` and ``inertia`` (distance summed over the cluster and over all), and
    ``centroid_sha256`` of the final centroid's components, joined with commas.

    Components become floor(64 * x). The first centroids are the ``k`` vectors with the
    smallest SHA-256 of ``<seed>:<id>``, in that order. In a round, the centroids are
    broadcast (``k`` by ``dim`` numbers), each partition sums its rows by nearest centroid,
    and the partitions' sums are merged by key; no row is shuffled. Of equally near
    centroids the first takes the row. All sums are whole numbers, so neither the order nor
    the number of partitions changes a result.

    Vectors that are null, of another length, or hold null or non-finite components are left
    out. Rows that repeat an id or a vector count each for themselves; of rows with one id
    the smaller vector comes first as a start. A null id is kept and comes last as a start.
    With fewer vectors than ``k`` there are as few centroids. Components beyond +-2^21 raise
    an error. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "centroids")
    points = ws.table(scaled_rows(vectors, id_col, vector_col).where(F.size("v") == dim), "points")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last()
    centroids = np.array([r["v"] for r in points.orderBy(order, "v").limit(k).select("v").collect()], dtype=np.int64).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(points, centroids)
    kind = points.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(centroids)
    assigned = ws.table(points.mapInPandas(_assign(shared), f"id {kind}, cluster int, distance long"), "assigned")
    ws.drop("points")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    by_cluster = [inertia.get(j, 0) for j in range(len(centroids))] or [0]
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()] or [""]
    of = lambda values: F.array(*map(F.lit, values))[F.col("cluster")]
    return assigned.select(F.col("id").alias(id_col), "cluster", "distance", of(by_cluster).cast("long").alias("cluster_inertia"), F.lit(sum(by_cluster)).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))
