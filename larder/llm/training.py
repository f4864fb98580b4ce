"""Labelled samples, model fitting in one task, and scoring, for the classifiers.

A model is fitted on at most a stated number of labelled rows, chosen by a hash of their id, in a single
task; its parameters have a fixed size and are the only thing that is broadcast.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import stage


def held_out(modulus: int, remainder: int) -> Column:
    """Rows that labels are never learnt from; a row without an id is not one of them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    return F.coalesce(fold == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, limit: int) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents, staged.

    A document labelled twice counts as 1 if any label is; of rows that repeat an id, the least text is
    taken. The chosen ids, at most ``limit``, are broadcast.
    """
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return stage(one.select("text", "label"), "labelled-sample")


def fitted(sample: DataFrame, fit) -> bytes:
    """``fit(texts, labels) -> bytes``, run in one task over the bounded sample."""
    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, labels)], pa.binary())], names=["model"])

    return bytes(sample.coalesce(1).mapInArrow(run, "model binary").first()["model"])


def scored(docs: DataFrame, model: bytes, load, score, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: ``score(load(model), texts) -> float64 array`` per batch. A column of that name is replaced."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        ready = load(shared.value)
        for batch in batches:
            found = score(ready, [t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             names=[*batch.schema.names, into])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(into)).schema)
