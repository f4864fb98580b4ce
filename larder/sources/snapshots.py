"""Tables that are upserted by rewriting only the buckets that change.

A table is a folder of bucket files and numbered manifests. Rows are dealt to a fixed number of buckets by a
hash of their keys. A manifest names the folder of every bucket, so it is the whole state of the table: an
upsert writes new folders for the buckets it touches, then publishes the next manifest by a rename that fails
if another writer was first (it then starts over from that writer's table). Readers take the newest manifest and
never see half a write; older versions stay readable. The manifest also keeps, per source, the number of the
last batch that it holds, so a batch that comes again changes nothing.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.ordered import newest
from larder.session import stage
from larder.sources import files

BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    return [p for p in files.children(spark, f"{folder}/manifests") if p.endswith(".json")]


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """The newest manifest, or that of a version."""
    found = _manifests(spark, folder)
    if version is not None:
        found = [p for p in found if p.endswith(f"/{version:012d}.json")]
    if not found:
        raise FileNotFoundError(f"no such table or version: {folder}")
    return json.loads(files.read_text(spark, found[-1]))


def create(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> None:
    """An empty table with these columns and keys; the keys cannot change."""
    first = {"version": 0, "keys": keys, "buckets": buckets, "schema": schema.jsonValue(), "folders": {}, "batches": {}}
    if not _publish(spark, folder, first):
        raise FileExistsError(folder)


def _publish(spark: SparkSession, folder: str, table: dict) -> bool:
    """Make a manifest visible at once; False if its number is taken."""
    draft = f"{folder}/manifests/_{uuid.uuid4().hex}"
    files.create_text(spark, draft, json.dumps(table))
    return files.rename_new(spark, draft, f"{folder}/manifests/{table['version']:012d}.json")


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as its newest, or a given, version holds it."""
    table = manifest(spark, folder, version)
    return _rows(spark, table, sorted(table["folders"]))


def _rows(spark: SparkSession, table: dict, buckets: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(table["schema"])
    paths = [table["folders"][b] for b in buckets if b in table["folders"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(folder: str, new: DataFrame, recency: list[str] | None = None, source: str | None = None, batch: int | None = None) -> int:
    """Put the rows of ``new`` in the place of those with their keys; the version that holds them.

    Of rows with equal keys the greatest by ``recency`` (column names) stays, whether old or new; without it
    new rows replace old ones and must differ in their keys. A ``batch`` of a ``source`` that the table has
    seen, or an empty one, leaves the table as it is.
    """
    spark = new.sparkSession
    while True:
        table = manifest(spark, folder)
        if source is not None and batch <= table["batches"].get(source, -1):
            return table["version"]
        columns = [f["name"] for f in table["schema"]["fields"]]
        staged = stage(new.select(*columns, _bucket(table["keys"], table["buckets"]).alias("_bucket")), "upsert")
        touched = sorted(r["_bucket"] for r in staged.select("_bucket").distinct().collect())
        if not touched and source is None:
            return table["version"]
        old = _rows(spark, table, [str(b) for b in touched])
        fresh = staged.drop("_bucket")
        if recency is None:
            merged = old.join(fresh.select(*table["keys"]), table["keys"], "left_anti").select(*columns).unionByName(fresh)
        else:
            merged = newest(old.unionByName(fresh), table["keys"], [F.col(c) for c in recency])
        place = f"{folder}/data/{uuid.uuid4().hex}"
        merged = merged.withColumn("_bucket", _bucket(table["keys"], table["buckets"]))
        # A bucket is one file where it is small; a large one is split over several tasks.
        merged.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(place)
        folders = table["folders"] | {str(b): f"{place}/_bucket={b}" for b in touched}
        batches = table["batches"] | ({source: batch} if source is not None else {})
        following = table | {"version": table["version"] + 1, "folders": folders, "batches": batches}
        if _publish(spark, folder, following):
            return following["version"]
        files.delete(spark, place)  # another writer was first


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions and the bucket folders that only they name.

    Run it while nobody writes: folders of a write that is under way are in no manifest yet.
    """
    found = _manifests(spark, folder)
    kept = {path for p in found[-keep:] for path in json.loads(files.read_text(spark, p))["folders"].values()}
    for p in found[:-keep]:
        files.delete(spark, p)
    used = {path.rpartition("/")[0].rpartition("/")[2] for path in kept}
    for write in files.children(spark, f"{folder}/data"):
        if write.rpartition("/")[2] not in used:
            files.delete(spark, write)
