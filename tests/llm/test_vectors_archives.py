"""Centroid clustering, WARC archives and whitening: brute force, round trips and odd tables."""

import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from contentmill.llm import warc
from contentmill.llm.centroids import centroid_clusters, nearest
from contentmill.llm.whitening import whiten
from contentmill.llm.workspace import Workspace

INF, NAN = float("inf"), float("nan")


def vectors(spark, rows, kind="bigint"):
    """The rows with extra columns under names that operators use inside."""
    df = spark.createDataFrame([(None if i is None else str(i) if kind == "string" else i, v) for i, v in rows], f"vec_id {kind}, embedding array<double>")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("id", "v", "x", "n", "total", "cluster", "d", "dim", "component", "deviation", "whitened", "centred", "apart")])


def cloud(n, dim, seed=3, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dim) * spread + (i % 5)).tolist()) for i in range(n)]


def lloyd(rows, dim, k, rounds):
    """Plain Python, one vector and one whole number at a time."""
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    rank = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [x for _, x in sorted(kept, key=lambda r: (rank(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        mine = [near(x)[1] for _, x in kept]
        for j in set(mine):
            own = [x for (_, x), m in zip(kept, mine, strict=True) if m == j]
            centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, near(x)[1], near(x)[0], hashlib.sha256(",".join(map(str, centres[near(x)[1]])).encode()).hexdigest()) for i, x in kept]
    by = {j: sum(d for _, c, d, _ in out if c == j) for _, j, _, _ in out}
    return sorted((str(i), j, d, by[j], sum(by.values()), h) for i, j, d, h in out)


def clusters(df, **how):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroid_clusters(df, **how).collect())


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_clusters_equal_plain_lloyd(spark, kind):
    rows = cloud(300, 5) + [(7, [9.0] * 5), (7, [9.0] * 5), (7, [-9.0] * 5), (None, [0.5] * 5), (2**60 + 1, [3.0] * 5)] + [(1000 + i, [0.25] * 5) for i in range(150)]
    odd = [(901, None), (902, [1.0] * 4), (903, []), (904, [1.0, NAN, 1.0, 1.0, 1.0]), (905, [INF] + [0.0] * 4), (906, [None] + [0.0] * 4)]
    assert clusters(vectors(spark, rows + odd, kind).repartition(7), dim=5, k=6, rounds=4) == lloyd(rows + odd, 5, 6, 4)


def test_clusters_of_few_equal_and_no_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])]
    assert clusters(vectors(spark, rows), dim=2, k=16) == lloyd(rows, 2, 16, 3)
    assert {r[1] for r in clusters(vectors(spark, rows), dim=2, k=16)} == {0}  # ties go to the first
    assert clusters(vectors(spark, rows), dim=3) == [] and centroid_clusters(vectors(spark, rows).limit(0), dim=2).count() == 0
    with pytest.raises(Exception, match="component out of range"):
        centroid_clusters(vectors(spark, [(1, [1e30, 0.0])]), dim=2)


def test_nearest_is_exact_and_first_of_ties():
    x = np.array([[2**26, 0], [0, 0]])
    near, squared = nearest(x, np.array([[0, 1], [0, -1], [2**26 + 1, 0]]))
    assert near.tolist() == [2, 0] and squared.tolist() == [1, 1]


def check_whitened(rows, found, k):
    x = np.array([[np.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    n = len(x)
    whole = [[int(c) for c in v] for v in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    centred = x - x.mean(axis=0)
    e, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    e, vectors_ = e[::-1][:k], vectors_[:, ::-1][:, :k]
    want = centred @ vectors_ / np.sqrt(e)
    places = {i: p for p, (i, _) in enumerate(rows)}
    got = np.full((n, k), np.nan)
    for r in found:
        at = places[r.vec_id]
        got[at, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(whole[at], sums, strict=True))
        assert abs(r.explained / (e[r.component - 1] / (centred**2).sum() * n) - 1) < 1e-9 and r.identity_error <= 1e-4
    assert len(found) == n * k and len({r.identity_error for r in found}) == 1
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, rtol=1e-7, atol=1e-7)


def test_whitening_equals_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=9) * np.linspace(3, 0.2, 9) + 5).tolist()) for i in range(400)]
    odd = [(901, None), (902, [1.0] * 4), (903, []), (904, [1.0] * 8 + [NAN]), (905, [INF] + [0.0] * 8), (906, [None] + [0.0] * 8)]
    df = vectors(spark, rows + odd).repartition(5)
    check_whitened(rows, whiten(df).collect(), 9)
    check_whitened(rows, whiten(df, components=3).collect(), 3)


def test_whitening_with_a_hot_vector_and_far_apart_scales(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5, 0.5, 0.5]) for i in range(300)] + [(300 + i, (rng.normal(size=3) * [20_000, 100, 1]).tolist()) for i in range(300)]
    check_whitened(rows, whiten(vectors(spark, rows)).collect(), 3)


def test_whitening_without_variance_and_of_text_ids(spark):
    assert whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    empty = whiten(vectors(spark, [(1, [1.0])]).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # A dimension that never varies is no component; repeated rows and null ids count.
    rows = [("a", [1.0, 0.0, 7.0]), ("a", [1.0, 0.0, 7.0]), (None, [0.0, 1.0, 7.0]), ("b", [2.0, 2.5, 7.0])]
    found = whiten(vectors(spark, rows, "string")).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted((str(i), c) for i, _ in rows for c in (1, 2))
    assert all(r.identity_error < 1e-9 for r in found) and abs(sum({r.component: r.explained for r in found}.values()) - 1) < 1e-9


def test_deviations_that_fit_no_long_are_null(spark):
    rows = [(i, [2.0**20 if i % 2 else -(2.0**20), float(i)]) for i in range(400)]
    found = whiten(vectors(spark, rows)).collect()
    assert len(found) == 800 and all(r.deviation is None and r.identity_error < 1e-4 for r in found)


# Archives.

PAGE = "<html><body>a page of some words that is long enough to be compared with others, number {} of them</body></html>"


def pages(spark, rows, kind="bigint"):
    df = spark.createDataFrame([(None if i is None else str(i) if kind == "string" else i, u, h) for i, u, h in rows], f"page_id {kind}, url string, html string")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("id", "page", "payload", "digest", "bytes", "first", "rows", "marked", "key", "frame", "path", "content", "error", "place")])


def expected(rows, least=100):
    sized = [(i, (h or "").encode()) for i, _, h in rows]
    firsts = {}
    for i, b in sized:
        if i is not None and len(b) >= least:
            firsts[b] = min(firsts.get(b, i), i)
    out = [(str(i), len(b), hashlib.sha256(b).hexdigest(), *(("revisit", str(firsts[b])) if b in firsts and firsts[b] != i else ("response", "None"))) for i, b in sized]
    return sorted(out)


def round_trip(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.warc_round_trip(df).collect())


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_round_trip(spark, kind):
    hot = PAGE.format("hot")
    rows = [(100 + i, f"http://a.org/{i}", PAGE.format(i % 40)) for i in range(200)] + [(400 + i, "http://b.org/", hot) for i in range(150)]
    rows += [(1, None, None), (2, "", ""), (3, "u", "short"), (4, "u", "short"), (5, "x y\r\nz: é", "é" * 50), (6, "u", "é" * 50), (7, "u", "e" * 99), (8, "u", "e" * 99), (9, "u", "a\r\n\r\nb\0" * 40), (10, "u" * 20_000, "<p>" * 400_000), (11, "u", "<p>" * 400_000)]
    rows += [(12, "u", PAGE.format("same")), (12, "v", PAGE.format("same")), (13, "v", PAGE.format("same")), (None, "u", PAGE.format("same")), (None, "u", PAGE.format("own")), (None, "u", PAGE.format("own"))]
    given = [(None if i is None else str(i), u, h) for i, u, h in rows] if kind == "string" else rows
    assert round_trip(pages(spark, rows, kind).repartition(6)) == expected(given)


def test_round_trip_of_ids_with_odd_characters_and_of_nothing(spark):
    rows = [("a b\r\nWARC-Type: x", "u", PAGE.format(1)), ("é%20:", "u", PAGE.format(1)), ("", "u", PAGE.format(2)), ("z", "u", PAGE.format(2))]
    assert round_trip(pages(spark, rows, "string")) == expected(rows)
    assert round_trip(pages(spark, rows, "string").limit(0)) == []


@pytest.fixture
def archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_FRAMES", 50)
    words = random.Random(1).choices("some words that pages share with one another in their text".split(), k=40_000)
    rows = [(i, f"http://a.org/{i}", "<html>" + " ".join(words[i * 99 : i * 99 + 300]) + f"{i}</html>") for i in range(300)]
    warc.write_warc(pages(spark, rows).coalesce(2), f"{tmp_path}/out")
    return tmp_path / "out", rows


def test_archives_open_with_their_dictionary_and_hold_a_frame_for_each_record(spark, archives):
    path, rows = archives
    files = [p for p in path.iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(files) > 4  # each holds ARCHIVE_FRAMES at most, the dictionary among them
    bodies = {}
    for p in files:
        data = p.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
        size = int.from_bytes(data[4:8], "little")
        assert size > 1000
        # A plain stream decoder that knows the dictionary passes over the skippable frames.
        known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        text = known.stream_reader(data[8 + size :], read_across_frames=True).read()
        assert text.count(b"WARC/1.1\r\n") == sum("error" not in r for r in warc.records_of(data)) <= 49
        bodies |= {r["page"]: r for r in warc.records_of(data)}
    assert len(bodies) == 300 and all(bodies[str(i)]["payload"] == h.encode() and bodies[str(i)]["target_uri"] == u for i, u, h in rows)
    found = warc.read_warc(spark, str(path)).collect()
    assert {(r.page, bytes(r.payload)) for r in found} == {(str(i), h.encode()) for i, _, h in rows} and not [r for r in found if r.error]


def test_broken_archives_are_rows_with_errors(spark, archives, tmp_path):
    data = next(p for p in sorted(archives[0].iterdir()) if p.name.startswith("part-") and p.stat().st_size).read_bytes()
    whole = list(warc.records_of(data))
    first = whole[0]["place"]
    cut = list(warc.records_of(data[:-30]))
    assert [r.get("error") for r in cut] == [None] * (len(whole) - 1) + ["cut-off frame"]
    flipped = bytearray(data)
    flipped[whole[1]["place"] - 12] ^= 255  # the checksum of the first record's frame
    got = list(warc.records_of(bytes(flipped)))
    assert "error" in got[0] and [r["place"] for r in got] == [r["place"] for r in whole] and not any("error" in r for r in got[1:])
    assert [r["error"] for r in warc.records_of(b"no archive at all")] == ["no frame"]
    unknown = list(warc.records_of(data[first:]))  # without its dictionary
    assert len(unknown) == len(whole) and all("error" in r for r in unknown)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a").write_bytes(data[:-30])
    (tmp_path / "bad/b").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path / "bad"), payloads=False).where("error is not null").count() == 1


def test_headers_and_lengths_are_validated():
    good = warc.record("1", "http://a.org/", hashlib.sha256(b"abc").hexdigest(), 3, b"abc", None, "2026-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"abc"
    for old, new, said in (
        (b"WARC/1.1", b"WORC/1.1", "no WARC header"),
        (b"WARC-Date: 2026-01-01T00:00:00Z\r\n", b"", "no warc-date"),
        (b"WARC-Type: response", b"WARC-Type response", "header line"),
        (b"WARC-Type: response", b"WARC-Type : response", "header line"),
        (b"abc", b"abd", "payload digest differs"),
        (b"abc", b"abcd", "content-length"),
        (b"\r\nContent-Length: ", b"\r\nContent-Length: -", "content-length"),
        (b"HTTP/1.1 200", b"HTTQ/1.1 200", "no HTTP header"),
        (b"response\r\n", b"revisit\r\n", "a revisit without"),
    ):
        with pytest.raises(warc.Malformed, match=said):
            warc.parse_record(good.replace(old, new, 1) if old != b"\r\nContent-Length: " else good.replace(old, new))


def test_dictionaries_may_be_compressed_or_absent():
    raw = warc.record(None, None, hashlib.sha256(b"").hexdigest(), 0, b"", None, "2026-01-01T00:00:00Z")
    known = warc.train_dictionary([raw + bytes([i % 7]) * (i % 50) + str(i * 977).encode() * 9 for i in range(2000)], 4096)
    assert known
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(known)).compress(raw)
    for stored in (known, zstandard.ZstdCompressor().compress(known)):
        data = warc.DICTIONARY_FRAME.to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored + frame
        assert [r.get("payload_bytes") for r in warc.records_of(data)] == [0]
    assert [r.get("payload") for r in warc.records_of(zstandard.ZstdCompressor().compress(raw))] == [b""]
    assert warc.train_dictionary([b"few"]) == b""


def test_revisits_must_agree_with_what_they_refer_to(spark):
    rows = [("r", "response", "<1>", "p1", None, 3, "d1"), ("r", "revisit", "<2>", "p2", "<1>", None, "d1"), ("r", "revisit", "<3>", "p3", "<9>", None, "d1"), ("r", "revisit", "<4>", "p4", "<1>", None, "d2")]
    records = spark.createDataFrame(rows, "archive string, record_type string, record_id string, page string, refers_to_id string, payload_bytes long, payload_digest string").withColumn("error", F.lit(None).cast("string"))
    found = {r.page: (r.refers_to, r.payload_bytes, r.error) for r in warc.resolve_revisits(records, Workspace(spark, "test")).collect()}
    assert found == {"p1": (None, 3, None), "p2": ("p1", 3, None), "p3": (None, None, "refers to no record"), "p4": ("p1", 3, "differs from the record it refers to")}
