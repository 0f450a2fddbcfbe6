"""Similarity joins against brute force: n-grams, embeddings, components."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from contentmill.llm import embedding_dedup, ngram_join
from contentmill.llm.components import connected_components
from contentmill.llm.workspace import Workspace


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def classes(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    return {i: find(parent, i) for i in ids}


def sets_of(texts, k):
    out = {}
    for i, t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        out[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    return out


def brute(texts, k, num, den):
    sets = sets_of(texts, k)
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in classes(ids, links).items()}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "Ünder"]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 3, 9, 10, 11, 30, 60, 140)))] for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(70):  # one large group of near copies, some of them closer
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(t[: rng.choice((120, 120, 118, 112, 106))])
    joined = [" ".join(t) if rng.random() < 0.7 else "\n".join(t).upper() for t in texts]
    joined += [None, "", " \t\n", "A b C", "a B c", "a b", "x" * 5000, joined[0], joined[70], joined[70]]
    return list(enumerate(joined, 3))


@pytest.mark.parametrize(("k", "num", "den", "light", "frequent"), [(3, 90, 100, 48, 65_536), (5, 80, 100, 4, 65_536), (2, 70, 100, 4, 0), (3, 1, 1, 4, 20)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, k, num, den, light, frequent):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "SIDE", 16)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "ORDER_SAMPLE", 1 if frequent == 20 else 8)
    texts = corpus(k)
    docs = spark.createDataFrame([(i, t, i, "clash") for i, t in texts], "doc_id long, text string, n long, id string").repartition(5)
    out = ngram_join.ngram_jaccard_join(docs, k=k, num=num, den=den)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(texts, k, num, den)


def test_templates_that_link_nothing(spark, monkeypatch):
    """A passage that fills two thirds of many documents makes a heavy column, but its n-grams
    stand late in all of them."""
    monkeypatch.setattr(ngram_join, "LIGHT", 8)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(80)]
    texts = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(40)] + passage)) for i in range(60)]
    texts += [(100 + i, t + " end") for i, t in texts[:3]]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = ngram_join.ngram_jaccard_join(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(texts, 5, 80, 100)


def test_ngram_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f")]
    out = sorted(map(tuple, ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert out == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    rng.shuffle(links)
    df = spark.createDataFrame([*links, (None, 3), links[0]], "a long, b long")
    got = {r.node: r.component for r in connected_components(Workspace(spark, "t"), df).collect()}
    expected = classes({x for p in links for x in p}, links)
    assert all(got.get(i, i) == c for i, c in expected.items())


@pytest.mark.parametrize(("side", "lists"), [(1024, 1024), (16, 1024), (1024, 1), (40, 5)])
def test_embeddings_equal_brute_force(spark, monkeypatch, side, lists):
    monkeypatch.setattr(embedding_dedup, "SIDE", side)
    monkeypatch.setattr(embedding_dedup, "MOST_LISTS", lists)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 24))
    x[300:420] = x[5] + 0.12 * rng.normal(size=(120, 24))  # a large group, by far not all of it linked
    x[420:440] = x[7]
    x = x.astype(np.float32)
    labels = [int(v) for v in rng.integers(0, 3, 700)]
    labels[300:440] = [1] * 140
    labels[5] = labels[7] = 1
    rows = [(i, [float(v) for v in x[i]], labels[i], "clash") for i in range(700)]
    rows += [(900, None, 1, ""), (901, [0.0] * 24, 1, ""), (902, [float("nan")] * 24, 1, ""), (903, [None] * 24, 1, ""), (904, rows[5][1], None, ""), (905, [], 1, ""), (906, [1.0, 2.0], 1, ""), (907, [2.0, 4.0], 1, ""), (907, [2.0, 4.0], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(df.repartition(4), slack=1.0).collect()}
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    near = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]
    expected = classes(range(700), links)
    assert len(links) > 1000
    for i in range(700):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), expected[i], expected[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906))
    assert (got[906].n_links, got[907].component_id, got[907].kept) == (1, 906, False)
    # The default probes lose few links.
    assert sum(r.n_links for r in embedding_dedup.embedding_near_dedup(df).collect()) >= 0.97 * len(links)


def test_embeddings_of_the_tables_with_near_copies(spark):
    """The table itself holds no link: every row gets a copy that is off by a fixed perturbation."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.embedding is not None]
    top = max(i for i, _, _ in rows) + 1
    rng = np.random.default_rng(8)
    near = []
    for i, v, label in rows:
        noise = rng.normal(size=len(v))
        near.append((top + i, [float(a) for a in np.array(v) + (i % 7) * 0.1 * np.linalg.norm(v) * noise / np.linalg.norm(noise)], label))
    both = rows + near
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dedup(spark.createDataFrame(both, "vec_id long, embedding array<float>, label int")).collect()}
    ids, labels = np.array([r[0] for r in both]), np.array([-1 if r[2] is None else r[2] for r in both])
    u = np.array([r[1] for r in both], dtype=np.float32).astype(float)
    u /= np.sqrt((u**2).sum(1))[:, None]
    linked = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :]) & (labels[:, None] >= 0)
    np.fill_diagonal(linked, False)
    exact = {int(i): int(n) for i, n in zip(ids, linked.sum(1), strict=True)}
    assert sum(exact.values()) > 500 and all(r.n_links <= exact[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(exact.values())


def test_embeddings_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_near_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 1), (2, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embedding_dedup.embedding_near_dedup(odd).collect()), key=str) == [(2, 0, 2, True), (None, 0, None, True)]


def test_blocks_of_the_same_documents_return_the_same_stars():
    sets = {7: range(100), 3: range(1, 101), 5: range(2, 102), 9: range(500, 540), 4: range(500, 541)}
    rows = [{"node": n, "side": 2, "grams": list(g)} for n, g in sets.items()]
    schema = pa.schema([("node", pa.int64()), ("side", pa.int32()), ("grams", pa.list_(pa.int64()))])
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r["node"])):
        found = ngram_join._dense_block(90, 100)(pa.Table.from_pylist(order, schema))
        assert sorted((r["a"], r["b"]) for r in found.to_pylist()) == [(3, 5), (3, 7), (4, 9)]


def test_a_block_of_near_copies_takes_little_memory():
    """Any two of 1,024 near copies are linked: a worker that lists these links takes some 145 MB
    for a moment, and an executor has several workers."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 300)
    grams = []
    for _ in range(1024):
        own = base.copy()
        own[rng.integers(0, 300, 3)] = rng.integers(-(2**62), 2**62, 3)
        grams.append(own)
    table = pa.table({"node": np.arange(5, 1029), "side": pa.array([2] * 1024, pa.int32()), "grams": pa.array(grams, pa.list_(pa.int64()))})
    multiply = ngram_join._dense_block(80, 100)
    tracemalloc.start()
    try:
        found = multiply(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(zip(*found.to_pydict().values(), strict=True)) == [(5, x) for x in range(6, 1029)]
    assert peak < 64e6


def test_a_batch_of_texts_takes_little_memory():
    rng = random.Random(6)
    texts = pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(350)) for _ in range(2000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), texts], ["id", "text"])
    run = ngram_join._sketches(3, 90, 100, np.empty(0, dtype=np.uint64))
    tracemalloc.start()
    try:
        rows = sum(part.num_rows for part in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000 and peak < 24e6


def test_sets_move_as_packed_texts():
    """A set of n-grams moves as its compressed text, which is far less than 8 bytes an n-gram."""
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(2000)}" for _ in range(1500)) for _ in range(20)]
    texts += [None, "", "a B", "É ß \n Ünder x" * 3, " ".join(f"v{i % 9973}" for i in range(300_000))]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["key", "text"])
    every = SimpleNamespace(value=np.full((1 << 26) // 8, 255, dtype=np.uint8))
    out = pa.Table.from_batches(ngram_join._sets(3, every)([batch]))
    assert out.column("key").to_pylist() == list(range(len(texts)))
    expected = sets_of(enumerate(texts), 3)
    assert sum(out.slice(0, 20).column(c).nbytes for c in out.column_names) < 4 * sum(len(expected[i]) for i in range(20))
    own = list(ngram_join._unpacked(3, *(out.column(c).combine_chunks() for c in ("size", "packed"))))
    assert [len(x) for x in own] == [len(expected[i]) for i in range(len(texts))]
    assert [ngram_join._set_hashes(x) for x in own] == list(zip(out.column("h1").to_pylist(), out.column("h2").to_pylist(), strict=True))


def test_stars_need_no_round(spark):
    """Small steps cost time by their number: a forest of stars is told from its links alone."""
    ws = Workspace(spark, "t")
    links = [(1, x) for x in range(2, 40)] + [(x, 50) for x in range(51, 60)] + [(3, 1), (70, 70), (None, 1)]
    found = connected_components(ws, spark.createDataFrame(links, "a long, b long"))
    assert ws.kept == ["cc-0"]
    assert {r.node: r.component for r in found.collect()} == {x: 1 for x in range(1, 40)} | {x: 50 for x in range(50, 60)}
    ws.free(*ws.held)
    chain = connected_components(ws, spark.createDataFrame([(x, x + 1) for x in range(30)] + [(30, 0)], "a long, b long"), "chain")
    assert len(ws.kept) == 2 and {r.node: r.component for r in chain.collect()} == dict.fromkeys(range(31), 0)
    ws.free(*ws.held)
    ws.drop(*list(ws.kept))
