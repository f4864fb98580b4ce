"""Session defaults and the shared folder for staged tables."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# AQE sizes and splits shuffle partitions at run time. The skew join is forced because most
# joins here feed an aggregate or window on the join key, where AQE would otherwise keep a hot
# key in one task to save the extra exchange.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the SQL options the operators are planned for; cluster sizing is left alone."""
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str, cpus: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_defaults(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local session without a setting falls back to a temporary folder; on a cluster a
    machine-local folder would lose data, so the missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir().name


@lru_cache(maxsize=1)
def _local_dir() -> tempfile.TemporaryDirectory:
    """Deleted when the local session's process ends."""
    return tempfile.TemporaryDirectory(prefix="larder-", ignore_cleanup_errors=True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside frees its shuffle files as it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def stage(df: DataFrame, label: str, row_group: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with its own schema.

    Used where several branches read the same aggregate: the source is scanned once, the
    lineage is cut and a lost executor costs a file read, not a recomputation. Tasks hold a row group of
    the files that they write or read: ``row_group`` bytes, by default Parquet's 128 MB. ``codec`` is Parquet's too.
    """
    path = new_path(df.sparkSession, label)
    options = {} if row_group is None else {"parquet.block.size": row_group}
    options |= {} if codec is None else {"compression": codec}
    df.write.mode("error").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
