"""Embedding near-duplicates by product quantisation with an exact cosine rerank."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmill.llm.components import connected_components, smallest_ids
from contentmill.llm.skew import join_hot
from contentmill.llm.workspace import Workspace

#: Expected rows of the training sample (of all lengths together), most inverted lists of a
#: length, subspaces and codes of each.
SAMPLE_ROWS, MOST_LISTS, SUBSPACES, CODES = 20_000, 1024, 8, 64
#: Rows of one side of a cell.
SIDE = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's iterations from k random rows; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(near, weights=x[:, d], minlength=len(centres))
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


class ProductQuantiser:
    """Coarse centres and, for residuals, a code book in each subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, lists)
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residual[:, p], CODES) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the length that the codes leave out."""
        lists = nearest(x, self.centres)
        residual = x - self.centres[lists]
        codes = np.column_stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)]).astype(np.uint8)
        known = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return lists, codes, np.sqrt(((residual - known) ** 2).sum(1))

    def probes(self, x: np.ndarray, lists: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each row the lists from its own on whose border is within ``reach``."""
        to = ((x[:, None, :] - self.centres[None, :, :]) ** 2).sum(2) if len(self.centres) * x.size <= 1 << 24 else np.vstack([((row - self.centres) ** 2).sum(1) for row in x])
        between = np.sqrt(np.maximum(((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(2), 1e-18)) if not hasattr(self, "between") else self.between
        self.between = between
        border = (to - to[np.arange(len(x)), lists][:, None]) / (2 * between[lists])
        border[np.arange(len(x)), lists] = 0
        return [np.flatnonzero((row <= reach) & (np.arange(len(row)) >= own)) for row, own in zip(border, lists, strict=True)]

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded rows of a list, from look-up tables."""
        residual = queries - self.centres[at]
        total = np.zeros((len(queries), len(codes)))
        for m, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            table = ((residual[:, p][:, None, :] - book[None, :, :]) ** 2).sum(2)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _index(models, reach: float):
    """Arrow batches (id, weight, label, dim, embedding) -> index rows, one for each list that a row probes.

    The row's own list comes first; ``home`` marks it.
    """

    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                model = models.value[int(dim)]
                for start in range(0, some.num_rows, 256):
                    part = some.slice(start, 256)
                    x = _unit(part.column(4), int(dim))
                    lists, codes, lost = model.encode(x)
                    probed = model.probes(x, lists, reach)
                    row = np.repeat(np.arange(len(x)), [len(p) for p in probed])
                    to = np.concatenate(probed) if len(probed) else np.empty(0, dtype=np.int64)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i).take(take) for i in range(4)), pa.array(to.astype(np.int64)), pa.array(to == lists[row]), pa.array([codes[r].tobytes() for r in row], pa.binary()), pa.array(lost[row]), pa.array([x[r].tobytes() for r in row], pa.binary())],
                        ["id", "weight", "label", "dim", "list", "home", "codes", "lost", "unit"],
                    )

    return run


def _cell(models, cosine: float):
    """Links of one cell: weights by row and the edges of a spanning forest."""
    farthest = sqrt(2 - 2 * cosine)

    def run(table: pa.Table) -> pa.Table:
        dim, at = table.column("dim")[0].as_py(), table.column("list")[0].as_py()
        ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
        role, home = table.column("role").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(-1, dim)
        q, m = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        out: dict[str, list] = {"id": [], "n": [], "other": []}
        if len(q) and len(m):
            codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(m)).to_pylist()), dtype=np.uint8).reshape(len(m), -1)
            lost = table.column("lost").to_numpy()[m]
            parent = {}

            def find(x):
                while (p := parent.setdefault(x, x)) != x:
                    parent[x] = parent[p]
                    x = p
                return x

            count: dict[int, int] = {}
            for lo in range(0, len(q), 128):
                rows = q[lo : lo + 128]
                near = models.value[dim].distances(unit[rows], at, codes) <= farthest + lost[None, :] + 1e-9
                near &= ~home[rows][:, None] | (ids[rows][:, None] < ids[m][None, :])
                i, j = np.nonzero(near)
                i, j = rows[i], m[j]
                exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                for x, y, wx, wy in zip(ids[i[exact]].tolist(), ids[j[exact]].tolist(), weights[i[exact]].tolist(), weights[j[exact]].tolist(), strict=True):
                    count[x] = count.get(x, 0) + wy
                    count[y] = count.get(y, 0) + wx
                    rx, ry = find(x), find(y)
                    if rx != ry:
                        parent[ry] = rx
                        out["id"].append(x), out["n"].append(0), out["other"].append(y)
            out["id"] += list(count)
            out["n"] += list(count.values())
            out["other"] += [None] * len(count)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def embedding_near_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, slack: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Near-duplicate vectors of equal label, one row per input row.

    Columns: the id, ``n_links`` (other vectors linked directly), ``component_id``
    (smallest id reachable) and ``kept`` (it is its own component's smallest id).

    Equal vectors are reduced to one weighted row. A quantiser is fitted on a bounded
    sample (by a hash of the id); every row is indexed. A pair is looked for once, by the
    row of the lower list, in every list whose border with its own list is at most
    ``slack`` times the linking distance away (1 finds every pair; a random direction in
    d dimensions needs about 3 / sqrt(d)). Table look-ups drop only pairs that even the
    length lost in coding can't bring within the distance; the rest get exact cosines. A
    list is dealt out in cells of at most about ``SIDE`` rows a side, and a cell returns
    sums and a forest, so a list with any share of the rows is split.

    Vectors that are null, empty, zero or hold null or non-finite components, or whose
    label is null, link with nothing; vectors of different length aren't compared. Ids may
    have any type that can be compared. An id that repeats with the same vector counts once
    and is returned for each row; one that repeats with different vectors stands for as
    many vectors of their own, each row with its own links. A null id gets 0 links and a
    null component. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "embedding-dedup")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = "id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    rows = ws.table(rows.withColumn("good", F.coalesce(F.expr(finite), F.lit(False))), "rows")
    same = rows.where("good").groupBy("label", "v", "id").agg(F.count("*").alias("n")).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.sum("n").alias("rows"))
    reps = ws.table(same.select(F.monotonically_increasing_id().alias("node"), "id", "weight", "rows", "label", F.size("v").alias("dim"), "v"), "reps")
    sizes = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    steps, drawn = 1 << 20, {}
    share = min(1.0, sample_rows / max(1, sum(sizes.values())))
    for row in reps.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(steps)) < F.lit(max(1, int(steps * share)))).select("dim", "v").toLocalIterator():
        drawn.setdefault(row["dim"], []).append(row["v"])
    models = {}
    for dim, n in sizes.items():
        sample = np.array(drawn.get(dim, []), dtype=float).reshape(-1, dim)
        sample /= np.sqrt((sample**2).sum(1))[:, None]
        models[dim] = ProductQuantiser(sample, min(MOST_LISTS, ceil(sqrt(n) / 2), max(1, len(sample))))
    shared = spark.sparkContext.broadcast(models)

    reach = slack * sqrt(2 - 2 * cosine)
    index = reps.select(F.col("node").alias("id"), "weight", "label", "dim", "v").mapInArrow(_index(shared, reach), "id long, weight long, label string, dim int, list long, home boolean, codes binary, lost double, unit binary")
    index = ws.table(index, "index")
    key = ["label", "dim", "list"]
    counts = index.groupBy(*key).agg(F.count("*").alias("rows"), F.ceil(F.count("*") / SIDE).alias("qs"), F.ceil(F.count_if("home") / SIDE).alias("ms"))
    dealt = join_hot(index, ws.table(counts.where("ms > 0"), "counts"), key, "rows").drop("rows")
    queries = dealt.withColumns({"role": F.lit(0), "i": F.pmod(F.xxhash64("id"), "qs"), "j": F.explode(F.expr("sequence(0L, ms - 1)"))})
    members = dealt.where("home").withColumns({"role": F.lit(1), "j": F.pmod(F.xxhash64("id"), "ms"), "i": F.explode(F.expr("sequence(0L, qs - 1)"))})
    # By cell, not by list: an earlier exchange by list would do for the grouping otherwise.
    cells = queries.unionByName(members).drop("qs", "ms").repartition(*key, "i", "j")
    found = ws.table(cells.groupBy(*key, "i", "j").applyInArrow(_cell(shared, cosine), "id long, n long, other long"), "found")
    ws.release()
    links = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    least = smallest_ids(ws, connected_components(ws, links), reps)
    counted = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    per_rep = reps.join(counted, "node", "left").join(least, "node", "left")
    per_rep = per_rep.select("label", "v", "rows", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("smallest", "id").alias("component"))
    linked = join_hot(rows.where("good"), ws.table(per_rep, "per-rep"), ["label", "v"], "rows").select("id", "links", "component")
    out = linked.unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return ws.finish(out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")))
