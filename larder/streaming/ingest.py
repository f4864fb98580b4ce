"""Continuous ingest of uploads into an upserted table."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.ordered import newest
from larder.sources import files, snapshots


def ingest(spark: SparkSession, uploads: str, schema: T.StructType, folder: str, checkpoint: str, recency: list[str],
           source: str = "uploads", files_per_batch: int | None = None, only: str | None = None) -> None:
    """Upsert all Parquet files that have arrived in ``uploads`` since the last call, then return.

    Each micro-batch is reduced to its newest row per key and published as one version of the table, with its
    number as commit key: a batch that is replayed after a failure, between the table's commit and the
    stream's, changes nothing. Numbers belong to the checkpoint; under a new one all files are read again, which
    changes no row either, as the newest stays. ``only`` is a condition on the arriving rows; rows without a key are dropped.
    """
    keys = snapshots.manifest(spark, folder)["keys"]

    def put(rows: DataFrame, batch: int) -> None:
        good = rows.dropna(subset=keys) if only is None else rows.dropna(subset=keys).where(only)
        one = newest(good, keys, [F.col(c) for c in recency])
        stream = json.loads(files.read_text(spark, f"{checkpoint}/metadata"))["id"]
        snapshots.upsert(folder, one, recency, f"{source}/{stream}", batch)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    (reader.parquet(uploads).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
