"""Odd tables through every operator and every stage of the pipeline: nulls, empty and very
long texts, ties, repeated rows, text ids, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contentmill.llm import decontaminate, embedding_dedup, html_text, licenses, mixing, ngram_join, pii, quality, secrets, url_filter

# Names that operators use inside.
CLASH = ("id", "row", "node", "n", "score", "spans", "start", "kind", "tokens", "key", "block", "gram", "side", "y", "x", "component", "seed", "share", "host", "segments", "_row", "_n", "rank", "best", "label_", "window", "_text", "_place", "_all", "_pieces", "hash", "doc", "short", "item_at")
LONG = "some words of a very long text that goes on, " * 25_000
SHORT = "a plain document with some words in it that is not long at all"


def build(spark, rows, names, kind):
    """The rows with extra columns; ``kind`` is the type of the first column."""
    df = spark.createDataFrame([(None if r[0] is None else str(r[0]) if kind == "string" else r[0], *r[1:]) for r in rows], f"{names[0]} {kind}, " + ", ".join(names[1:]))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


DOCS = [(1, SHORT, "en", "s1", 5), (2, None, "en", "s1", 0), (3, "", None, None, None), (4, " \t\n", "en", "s2", 3), (None, SHORT, "en", "s2", 5), (1, SHORT, "en", "s1", 5), (5, LONG, "en", "s2", 9), (6, SHORT, "en", "s1", 5), (5, "another text under an id that is taken", "en", "s2", 9)]


def documents(spark, kind="bigint"):
    return build(spark, DOCS, ("doc_id", "text string", "lang string", "source string", "n_chars long"), kind)


def labels(spark, kind="bigint"):
    return build(spark, [(1, 1, 0), (6, 0, 0), (2, None, 0), (None, 1, 0), (5, 1, 1), (5, 0, 1)], ("doc_id", "quality int", "toxic int"), kind)


def benchmark(spark, kind="bigint"):
    return build(spark, [(7, "some words of a very long text that goes on"), (8, None), (9, ""), (None, SHORT), (7, "some words of a very long text that goes on")], ("item_id", "text string"), kind)


def ids(df, column="doc_id"):
    return sorted(str(r[0]) for r in df.select(column).collect())


ALL = sorted(str(r[0]) for r in DOCS)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_documents_through_every_operator(spark, kind):
    docs, told = documents(spark, kind), labels(spark, kind)
    found = secrets.secret_digest(secrets.scan_secrets(docs))
    assert ids(found) == ALL and found.where("spans <> ''").isEmpty() and dict(found.dtypes)["doc_id"] == kind
    found = quality.classify_quality(docs, told)
    assert ids(found) == ALL and dict(found.dtypes)["doc_id"] == kind
    assert found.where("score is null or (doc_id is null and held_out)").isEmpty()
    assert len({r.score for r in found.where("doc_id in (1, 6)").collect()}) == 1
    found = pii.pii_digest(pii.find_pii(docs))
    assert ids(found) == ALL and found.where("spans <> ''").isEmpty()
    found = ngram_join.ngram_jaccard_join(docs)
    assert ids(found) == ALL and dict(found.dtypes)["component_id"] == kind
    assert {(r.doc_id, r.component_id) for r in found.where("n_shingles > 0").collect()} == {(docs.schema["doc_id"].dataType.fromInternal(str(a) if kind == "string" else a), str(b) if kind == "string" else b) for a, b in ((1, 1), (6, 1), (5, 5))} | {(None, None)}
    assert ngram_join.ngram_jaccard_join(docs, num=1, den=1).where("n_shingles > 0").count() == 6
    assert licenses.scan_licenses(docs).isEmpty()
    tied = build(spark, [(1, "Released under the MIT License.\n" * 3 + LONG), (1, "Released under the MIT License.\n" * 3 + LONG), (None, "Licensed under CC BY 4.0.")], ("doc_id", "text string"), kind)
    assert sorted((str(r.doc_id), r.license) for r in licenses.scan_licenses(tied).collect()) == [("1", "MIT"), ("None", "CC-BY-4.0")]
    found = decontaminate.contaminated(docs, benchmark(spark, kind))
    assert [(str(r.doc_id), str(r.item_id)) for r in found.collect()] == [("5", "7")] and dict(found.dtypes)["item_id"] == kind
    found = mixing.mix_sources(docs)
    assert set(ids(found)) <= set(ALL) and found.where("source is null").isEmpty()
    assert secrets.mask_secrets(docs).columns == docs.columns and ids(secrets.mask_secrets(docs)) == ALL


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_pages_through_every_operator(spark, kind):
    rows = [(1, "http://a.org/x/1", f"<p>{SHORT}"), (2, None, None), (3, "", ""), (None, "http://a.org/x/1", "<p " + "a" * 1_000_000), (1, "http://a.org/x/1", f"<p>{SHORT}"), (4, "x://" + "/y" * 300_000, "<article>" + LONG)]
    pages = build(spark, rows, ("page_id", "url string", "html string"), kind)
    expected = sorted(str(r[0]) for r in rows)
    found = url_filter.filter_urls(pages, [("block", "org", "/x/")])
    assert ids(found, "page_id") == expected and dict(found.dtypes)["page_id"] == kind
    assert {r.verdict for r in found.where("host = 'a.org'").collect()} == {"block"}
    found = html_text.extract_text(pages)
    assert ids(found, "page_id") == expected and {(str(r.page_id), r.n_chars) for r in found.collect()} == {("1", len(SHORT)), ("2", 0), ("3", 0), ("None", 0), ("4", len(LONG.strip()))}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_vectors_through_the_operator(spark, kind):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (1, [1.0, 0.01], 1), (2, [0.01, 1.0], 1), (3, None, 1), (4, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (6, [2.0] * 3000, 1), (1, [1.0, 0.01], 1), (7, [], 1)]
    vectors = build(spark, rows, ("vec_id", "embedding array<float>", "label int"), kind)
    found = embedding_dedup.embedding_near_dedup(vectors)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in found.collect())
    # Of the two vectors under id 5, each is linked with its own neighbour only.
    assert got == sorted([("5", 1, "1", False), ("5", 1, "2", False), ("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "2", True), ("3", 0, "3", True), ("4", 0, "4", True), ("None", 0, "None", True), ("6", 0, "6", True), ("7", 0, "7", True)])


def test_empty_tables(spark):
    docs, pages = documents(spark).limit(0), build(spark, [(1, "u", "h")], ("page_id", "url string", "html string"), "bigint").limit(0)
    vectors = build(spark, [(1, [1.0], 1)], ("vec_id", "embedding array<float>", "label int"), "bigint").limit(0)
    for found in (secrets.scan_secrets(docs), quality.classify_quality(docs, labels(spark).limit(0)), pii.find_pii(docs), ngram_join.ngram_jaccard_join(docs), licenses.scan_licenses(docs), decontaminate.contaminated(docs, benchmark(spark)), decontaminate.contaminated(documents(spark), benchmark(spark).limit(0)), mixing.mix_sources(docs), url_filter.filter_urls(pages, []), html_text.extract_text(pages), embedding_dedup.embedding_near_dedup(vectors)):
        assert found.count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    labels(spark).write.parquet(f"{at}/labels.parquet")
    benchmark(spark).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, folder, name):
    docs, stage = documents(spark), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, folder)
    if name != "mixing_sources":
        assert out.columns == docs.columns
    if name == "quality_classifier":
        # Both labels go to equal texts: nothing is separable, all score 0.3 or more alike.
        assert set(ids(out)) <= set(ALL)
    if name == "ngram_near_copies":
        # One of each group of near copies, everything without words, and rows without an id.
        assert ids(out) == sorted(["1", "2", "3", "4", "5", "5", "None"])
        assert sorted(len(r.text) for r in out.where("doc_id = 5").collect()) == sorted([len(LONG), len("another text under an id that is taken")])
    if name == "benchmark_decontamination":
        assert ids(out) == sorted(i for i in ALL if i != "5")
    if name == "secret_scans":
        assert ids(out) == ALL and out.where("text is null").count() == 1
    if name == "mixing_sources":
        assert out.count() > 0


def test_stage_keeps_one_of_rows_that_repeat_an_id_with_copies(spark, folder):
    copy = SHORT.upper()
    rows = [(3, SHORT, "en"), (5, copy, "en"), (5, "a text of its own under the same id as a copy of three", "en"), (5, copy, "en")]
    docs = build(spark, rows, ("doc_id", "text string", "lang string"), "bigint")
    out = dict(corpus_pipeline.STAGES)["ngram_near_copies"](spark, docs, folder)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, SHORT), (5, rows[2][1])]
