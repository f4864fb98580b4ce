"""Helpers shared by the operators: registration, row streams and word splitting."""

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import apply_defaults, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``, with DuckDB SQL for the same rows if there is any."""
    def add(fn):
        def run(spark, sf_dir):
            return fn(apply_defaults(spark), sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            ORACLE[key] = oracle
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(col: str):
    """The bytes of a text column; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def batched(records: Iterable[tuple], schema: pa.Schema, size: int = 8192,
            limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows and about ``limit`` bytes of values."""
    held, weight = [], 0
    for record in records:
        held.append(record)
        weight += sum(len(v) for v in record if isinstance(v, (bytes, str)))
        if len(held) >= size or weight >= limit:
            yield to_batch(held, schema)
            held, weight = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(records: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*records), schema)], schema=schema)


@contextmanager
def small_batches(spark: SparkSession, n_rows: int = 1024, n_bytes: int = 4 << 20, n_read: int = 4096):
    """While plans are run in here, tasks hand so many rows or bytes to Python at a time: rows are texts and lists.

    Files are read ``n_read`` rows at a time, 4,096 being what Spark does by itself.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": n_rows, "spark.sql.execution.arrow.maxBytesPerBatch": n_bytes,
              "spark.sql.parquet.columnarReaderBatchSize": n_read}
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, limit in limits.items():
        spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def free_name(wanted: str, docs: DataFrame) -> str:
    """``wanted``, made longer while ``docs`` has such a column (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# Nodes of a plan that hand on each row of a file once at most.
ONE_TO_ONE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def in_files(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of a file, and no row of a file is there twice."""
    node = docs._jdf.queryExecution().analyzed()
    while str(node.nodeName()) in ONE_TO_ONE:
        if node.children().isEmpty():
            return "HadoopFsRelation" in node.relation().getClass().getName()
        node = node.children().head()
    return False


def marked(docs: DataFrame, label: str = "located") -> tuple[DataFrame, str]:
    """``docs`` with the place of each row (file, row), and that column's name.

    Only rows of a plain scan have a place of their own; all others are staged first.
    """
    name = free_name("at", docs)
    if not in_files(docs):
        docs = stage(docs, label)
    place = docs.metadataColumn("_metadata")
    at = F.struct(place["file_path"].alias("file"), place["row_index"].alias("row"))
    return docs.select("*", at.alias(name)), name
