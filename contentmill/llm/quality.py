"""Quality classifier: random Fourier features, ridge scores, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentmill.llm.hashing import Block, blocks
from contentmill.llm.workspace import Workspace

#: Expected number of labelled rows that the model is fitted on, drawn by a hash of the id.
SAMPLE_ROWS = 20_000
#: Random features, kernel width (in standard deviations of the statistics) and ridge penalty.
FEATURES, WIDTH, RIDGE = 192, 4.0, 1e-2
#: Share of the score that keeps the order of raw scores within calibrated steps.
ORDERING = 0.02

_CLASSES = ("lower", "upper", "digit", "stop", "mark", "symbol", "pipe", "space", "line", "high")
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 9
for _chars, _no in ((".,;:'\"-()", 3), ("!?", 4), ("|", 6), (" \t\r\x0b\x0c", 7), ("\n", 8)):
    _CLASS[[ord(c) for c in _chars]] = _no
STATISTICS = 26


def statistics(block: Block) -> np.ndarray:
    """One row of statistics for each document; zeros where a ratio has no base."""
    docs = len(block.bounds) - 1
    size = np.diff(block.bounds)
    owner = np.repeat(np.arange(docs), size)
    k = len(_CLASSES)
    kinds = np.bincount(owner * k + _CLASS[block.data], minlength=docs * k).reshape(docs, k).astype(float)
    words = np.diff(block.word_at)
    length = (block.ends - block.starts).astype(float)
    first, last = _CLASS[block.data[block.starts]], _CLASS[block.data[block.ends - 1]]
    word_owner = np.repeat(np.arange(docs), words)

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner, weights=x, minlength=docs)

    def ratio(a, b):
        return np.divide(a, b, out=np.zeros(docs), where=np.asarray(b) > 0)

    breaks = np.flatnonzero(block.data == 10)
    line_starts = np.union1d(block.bounds[:-1][size > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(block.data)]
    lines = np.bincount(owner[line_starts], minlength=docs).astype(float) if len(line_starts) else np.zeros(docs)
    at = np.searchsorted(block.starts, line_starts)
    shingles, bounds = block.shingles(3)
    distinct, repeats, top, same_lines = (np.zeros(docs) for _ in range(4))
    line_at = np.searchsorted(line_starts, block.bounds)
    for i in range(docs):
        if not words[i]:
            continue
        own = np.sort(block.words[block.word_at[i] : block.word_at[i + 1]])
        runs = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        distinct[i], top[i] = len(runs) - 1, np.diff(runs).max()
        repeats[i] = 1 - len(np.unique(shingles[bounds[i] : bounds[i + 1]])) / (bounds[i + 1] - bounds[i])
        a, b = line_at[i], line_at[i + 1]
        if b - a > 1:
            w = [block.words[x:y].tobytes() for x, y in zip(at[a:b], np.append(at[a + 1 : b], block.word_at[i + 1]), strict=True)]
            same_lines[i] = 1 - len(set(w)) / len(w)
    total = size.astype(float)
    solid = total - kinds[:, 7] - kinds[:, 8]
    letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 9]
    mean = ratio(per_doc(length), words)
    spread = np.sqrt(np.maximum(ratio(per_doc(length**2), words) - mean**2, 0))
    return np.column_stack(
        [
            np.log1p(total), np.log1p(words), np.log1p(lines), mean, spread, ratio(words, lines) ** 0.5,
            ratio(kinds[:, 1], letters), ratio(kinds[:, 2], solid), ratio(kinds[:, 3], solid), ratio(kinds[:, 4], solid), ratio(kinds[:, 5], solid), ratio(kinds[:, 6], solid), ratio(kinds[:, 9], solid),
            np.sqrt(ratio(kinds[:, 4], solid)), np.sqrt(ratio(kinds[:, 5], solid)), np.sqrt(ratio(kinds[:, 6], solid)), np.sqrt(ratio(kinds[:, 1], letters)),
            ratio(distinct, words), ratio(distinct, np.sqrt(words)), ratio(top, words), repeats, np.sqrt(repeats), same_lines,
            ratio(per_doc((last == 5) | (last == 4)), words), ratio(per_doc(first == 1), words), (words > 0).astype(float),
        ]
    )


def _measure(batches):
    for batch in batches:
        for block in blocks(batch.column(1)):
            x = statistics(block)
            part = [batch.column(i)[block.first : block.last] for i in (0, *range(2, batch.num_columns))]
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part, rows], ["id", *batch.schema.names[2:], "x"])


class QualityModel:
    """Ridge over Fourier features of standardised statistics, then calibrated.

    ``weights`` is None when the labels can't separate anything; every score is then
    the smoothed share of label 1.
    """

    def __init__(self, prior: float, mean=None, scale=None, weights=None, knots=None):
        rng = np.random.default_rng(11)
        self.prior, self.mean, self.scale, self.weights, self.knots = prior, mean, scale, weights, knots
        self.directions = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), z / 8, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        raw = self.raw(x)
        return np.clip((1 - ORDERING) * np.interp(raw, *self.knots) + ORDERING / (1 + np.exp(-np.clip(4 * raw, -50, 50))), 0, 1)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing step function, by pooling violators."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum, count, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([v, 1.0, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _one_each(rows: DataFrame) -> DataFrame:
    """One row of each id; of different texts under one id, the one with the least statistics."""
    return rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.y", "r.x")


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fits on a sample of labelled documents whose crc32(id as text) mod 5 isn't 0.

    About ``sample_rows`` of them are drawn by a hash of the id, so the sample is bounded
    however large the tables are. An id with several labels counts as 1 from a mean of 0.5.
    """
    ws = Workspace(docs.sparkSession, "quality")
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null and crc32(cast(id as string)) % 5 <> 0")
    usable = ws.table(usable.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y")), "labels")
    n = usable.count()
    steps = 1 << 20
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(steps)) < int(steps * min(1.0, sample_rows / max(n, 1))))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = ws.table(texts.mapInArrow(_measure, f"id {texts.schema['id'].dataType.simpleString()}, y double, x array<double>"), "rows")
    rows = _one_each(rows).coalesce(16)
    held = "pmod(xxhash64(id, 7), 4) = 0"
    stats = rows.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(STATISTICS)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(STATISTICS)]).first()
    count, ones = stats["n"], stats["ones"] or 0.0
    prior = (ones + 1) / (count + 2)
    if not 0 < ones < count:
        return QualityModel(prior)
    mean = np.array([stats[f"m{i}"] for i in range(STATISTICS)])
    scale = np.array([stats[f"s{i}"] for i in range(STATISTICS)])
    model = QualityModel(prior, mean, np.where(scale > 1e-9, scale, 1.0))

    def sums(batches):
        size = FEATURES + STATISTICS + 1
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(1).to_pylist()))
                a += z.T @ z
                b += z.T @ (2 * batch.column(0).to_numpy() - 1)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    parts = rows.where(f"not ({held})").select("y", "x").mapInArrow(sums, "a binary, b binary").collect()
    size = FEATURES + STATISTICS + 1
    a = sum((np.frombuffer(p["a"]).reshape(size, size) for p in parts), np.zeros((size, size)))
    b = sum((np.frombuffer(p["b"]) for p in parts), np.zeros(size))
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, count / 1000) * np.eye(size), b)

    def raws(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.raw(np.array(batch.column(1).to_pylist())))], ["y", "r"])

    check = rows.where(held).select("y", "x").mapInArrow(raws, "y double, r double").collect() or rows.select("y", "x").mapInArrow(raws, "y double, r double").collect()
    model.knots = isotonic(np.array([r["r"] for r in check]), np.array([r["y"] for r in check]))
    ws.drop("labels", "rows")
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` and ``predicted``; odd rows as in ``classify_quality``."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[block.first : block.last], pa.array(model.score(statistics(block)))], ["id", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, score double").select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all columns, without a shuffle.

    Null and blank texts are scored like any text without words; each row is judged by its
    text alone, so equal texts stay or go together, under any id; columns may have any
    names; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            score = [model.score(statistics(block)) for block in blocks(text)]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` in 0..1 and ``predicted``.

    Only statistics of the text enter a score: random Fourier features of them, and the
    standardised statistics themselves. ``ORDERING`` of a score is a sigmoid of the raw
    score, which orders rows within a step of the isotonic calibration. Null and blank texts are scored like any
    text without words; repeated rows get equal scores; a null id stays null and isn't
    held out; other columns are ignored; an empty table gives an empty result. Without
    labels of both classes every score is the smoothed share of label 1.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_rows=sample_rows)
    return score_quality(docs, model, id_col=id_col, text_col=text_col, threshold=threshold)
