"""Cleaning and mixing of a corpus: a fixed order of operators over ``documents``.

Each stage takes what its predecessor kept, as a table in the shared folder, and all but
the last return the columns of ``documents``. Further columns stay, whatever their names; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentmill.llm.decontaminate import decontaminate
from contentmill.llm.mixing import mix_sources
from contentmill.llm.ngram_join import ngram_jaccard_join
from contentmill.llm.quality import fit_quality, keep_quality
from contentmill.llm.secrets import mask_secrets
from contentmill.llm.workspace import Workspace

#: Rows that a Python worker gets at once. A batch of whole texts takes its size several times
#: over in the worker, and in its executor beside the heap.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to ``BATCH_ROWS``. Stages are planned when their
    result is written, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the table's own labels.

    Null and empty texts are scored like any text without words; equal texts stay or go together.
    """
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, id_col="doc_id", text_col="text", label_col="quality")
    return keep_quality(docs, model)


def ngram_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows are told apart by id and text, so an id that repeats with different texts stands
    for as many documents; of equal rows of an id one stays. Texts without words aren't
    grouped, nor are rows without an id: those all stay.
    """
    _small_batches(spark)
    # The row is packed up, so that no column of it can clash with those beside it.
    packed = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").alias("text"))
    found = ngram_jaccard_join(packed.select(F.struct("id", "hash").alias("doc"), "text"), id_col="doc")
    kept = found.where("n_shingles = 0 or doc = component_id").select("doc.id", "doc.hash").distinct()
    one = packed.join(kept, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Rows that repeat an id go together; rows without id, text or words stay.
    """
    _small_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, and ``n_chars`` follows.

    A null text stays null, with a null ``n_chars``; repeated rows are each masked.
    """
    return mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order of the kept documents: one row for each document and pass.

    A null source is one of its own; texts without tokens come along; repeated rows are documents of their own.
    """
    return mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_near_copies", ngram_near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
]

#: A trained classifier has no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name)
        ws.release()
        if before:
            ws.drop(before)
        before = name
    return docs
