"""The pipeline's stages, one by one, against brute force on their own inputs."""

import pyarrow as pa
import pytest

import corpus_pipeline
from contentmill.llm.workspace import Workspace
from tests.llm.test_pairs import brute
from tests.llm.test_scans import base_secrets, brute_quality, check_mixing


@pytest.fixture(scope="module")
def stages(spark, small):
    ws = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = ws.table(stage(spark, docs, small), name)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(stages):
    assert list(stages) == ["input", "quality_classifier", "ngram_near_copies", "benchmark_decontamination", "secret_scans", "mixing_sources"]
    assert all(stages[s].columns == stages["input"].columns for s in list(stages)[:-1])


def test_quality(spark, small, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = ids(stages["quality_classifier"])
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    scores = brute_quality({r.doc_id: r.text for r in stages["input"].collect()}, labels)
    assert all((i in kept) == (s >= 0.3) for i, s in scores.items() if abs(s - 0.3) > 1e-6)
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_near_copies(stages):
    texts = [(r.doc_id, r.text) for r in stages["quality_classifier"].collect()]
    assert ids(stages["ngram_near_copies"]) == {i for i, (_, c) in brute(texts, 5, 80, 100).items() if i == c}


def test_decontamination(spark, small, stages):
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before, after = stages["ngram_near_copies"].collect(), ids(stages["benchmark_decontamination"])
    held = {r.doc_id for r in before if any(t in " ".join(r.text.split()) for t in items)}
    assert held and not held & after and len(before) - len(after) <= 2 * len(held)


def test_workers_get_small_batches(spark, stages):
    rows = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert max(r.n for r in rows.collect()) <= 1000


def test_secrets(stages):
    before = {r.doc_id: r.text for r in stages["benchmark_decontamination"].collect()}
    after = {r.doc_id: r for r in stages["secret_scans"].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert not base_secrets(after[i].text) and after[i].n_chars == len(after[i].text)
        if not base_secrets(t):
            assert after[i].text == t


def test_mixing(stages):
    out = stages["mixing_sources"].collect()
    assert {r.doc_id for r in out} <= ids(stages["secret_scans"]) and len({(r.doc_id, r["pass"]) for r in out}) == len(out)
    total = sum(len(r.text.split()) for r in stages["secret_scans"].collect())
    assert 0.8 * total <= sum(r.n_tokens for r in out) <= total
    check_mixing([(r.doc_id, r.text, r.source) for r in stages["secret_scans"].collect()], out, 0.98, 4.0)


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
