"""Exact deduplication over a keyed streaming state.

Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``. Digests of the
normalised texts arrive as a stream. The state is keyed by digest, never expires and lives in
RocksDB with its snapshots in the shared folder; per key it holds the group size, the identifier of
the best row and that row's content locator (file and row). Rows whose digest is held by others
("hits") are then compared in full with the text at the locator, so a digest collision cannot merge
different texts. Everything is DataFrame code.

Defined results: a null text is empty and all empty texts are one group; a null ``doc_id`` loses
against any other; rows that repeat a ``doc_id`` are separate rows and exactly one row of a group
stays (by locator); an empty table gives an empty result; other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.base import marked, query, table
from larder.session import new_path, stage

# Each state partition would otherwise reserve several MB of disk for logs that stay nearly empty.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def squeezed(text: str = "text") -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(F.col(text), F.lit(""))
    for char in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def keyed_state(arrivals: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """One row per digest: its size and its best row, held as streaming state.

    ``arrivals`` (digest, doc_id, n_points, at) is written to the shared folder and read as a
    stream, in micro-batches of ``files_per_batch`` files (all files by default).
    """
    spark = arrivals.sparkSession
    source, checkpoint = new_path(spark, "dedup-arrivals"), new_path(spark, "dedup-state")
    arrivals.write.parquet(source)
    reader = spark.readStream.schema(arrivals.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(source).groupBy("digest").agg(
        F.count(F.lit(1)).alias("size"),
        F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rank"), "at")).alias("best"))
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        (state.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
         .option("checkpointLocation", checkpoint).start().awaitTermination())
        held = spark.read.format("statestore").load(checkpoint)
        size, best = held.schema["value"].dataType.names
        return stage(held.select(
            "key.digest", F.col(f"value.{size}").alias("size"), F.col(f"value.{best}").alias("best")),
            "dedup-held")
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def exact_groups(docs: DataFrame, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """Per row: doc_id, at (locator), keep_id, group_size, kept, digest."""
    placed, at = marked(docs.select("doc_id", "text"), "dedup-texts")
    return groups_of(placed.withColumnRenamed(at, "at"), digest, files_per_batch)


def groups_of(texts: DataFrame, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """The same for rows that have their locator ``at``."""
    norm = squeezed()
    arrivals = texts.select(
        digest(norm).alias("digest"), "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), "at")
    if arrivals.isEmpty():
        empty = T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("at", arrivals.schema["at"].dataType),
            T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()),
            T.StructField("kept", T.BooleanType()), T.StructField("digest", T.StringType())])
        return texts.sparkSession.createDataFrame([], empty)
    state = keyed_state(arrivals, files_per_batch)

    lone = state.where("size = 1").select(
        F.bitwise_not("best.rank").alias("doc_id"), "best.at", F.bitwise_not("best.rank").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")

    # Hits: the full bytes of both rows are compared. A text that differs from the keeper's in spite
    # of its digest is grouped by its own bytes.
    shared = state.where("size > 1").select("digest", F.col("best.at").alias("keeper"))
    hits = texts.withColumns({"norm": norm, "n_points": F.length(F.coalesce("text", F.lit(""))).cast("long")})
    hits = hits.withColumn("digest", digest(F.col("norm"))).drop("text").join(shared, "digest")
    hits = stage(hits, "dedup-hits")
    kept_text = hits.where("at = keeper").select("digest", F.col("norm").alias("kept_norm"))
    checked = stage(hits.join(kept_text, "digest").select(
        "digest", "doc_id", "at", "n_points",
        F.when(F.col("norm") != F.col("kept_norm"), F.col("norm")).alias("odd")), "dedup-checked")
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("rank"), "at"))
    classes = checked.groupBy("digest", "odd").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    classes = stage(classes, "dedup-classes")  # so that the join with a large group can be split
    joined = checked.alias("c").join(
        classes.alias("k"), (F.col("c.digest") == F.col("k.digest")) & F.col("c.odd").eqNullSafe(F.col("k.odd")))
    grouped = joined.select(
        "c.doc_id", "c.at", F.bitwise_not("k.best.rank").alias("keep_id"), "k.group_size",
        (F.col("c.at") == F.col("k.best.at")).alias("kept"), "c.digest")
    return lone.unionByName(grouped)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    placed, at = marked(docs, "dedup-texts")
    texts = placed.select("doc_id", "text", F.col(at).alias("at"))
    dropped = groups_of(texts).where("not kept").select(F.col("at").alias(at))
    return placed.join(dropped, at, "left_anti").drop(at)


@query("op2_exact_dedup", oracle=r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n_points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    r AS (
        SELECT doc_id, norm, first_value(doc_id) OVER g AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size
        FROM d WINDOW g AS (PARTITION BY norm ORDER BY n_points DESC, doc_id))
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""")
def op2_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
