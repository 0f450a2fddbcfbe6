"""Continuous intake: new files of rows, added once by their keys.

A stored table is plain parquet, partitioned by buckets of its keys. Of what is stored, a
batch reads the keys of the buckets that its own keys fall in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contentmill.operators.store import new_rows

#: Buckets of a new table. A table keeps the number it was begun with.
BUCKETS = 256


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row's keys; keys that print alike share one, whatever their type."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def stored_rows(spark: SparkSession, root: str, schema: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """Rows of the table at ``root``, of these buckets only if given; none if it has none yet.

    Buckets are folders, so others aren't opened.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _bucket int").parquet(root)
    return (rows if buckets is None else rows.where(F.col("_bucket").isin(list(buckets)))).drop("_bucket")


def add_rows(rows: DataFrame, root: str, *, schema: str, keys: Sequence[str], order: str, buckets: int = BUCKETS) -> None:
    """Appends the first row of each key by ``order`` whose key isn't stored.

    The driver learns which buckets the rows fall in, ``buckets`` numbers at most. The
    rows of a bucket go to one file. One writer at a time: two that add the same new key
    at once would both store it. Rows with a null key are never stored ones, so they are
    added each time.
    """
    placed = rows.withColumn("_bucket", bucket_of(keys, buckets))
    touched = [r[0] for r in placed.select("_bucket").distinct().collect()]
    if touched:
        stored = stored_rows(rows.sparkSession, root, schema, touched)
        fresh = new_rows(placed, stored, keys, order)
        names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
        fresh.select(*names, "_bucket").repartition("_bucket").write.partitionBy("_bucket").mode("append").parquet(root)


def watch_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder, multiLine=True)


def intake(stream: DataFrame, root: str, checkpoint: str, *, schema: str, keys: Sequence[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Adds each batch's new keys to the table at ``root``; available data, then stops.

    A batch that is replayed after a failure finds stored what it had added, and adds the rest.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        add_rows(batch.withColumn("_place", F.monotonically_increasing_id()), root, schema=schema, keys=keys, order="_place", buckets=buckets)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
