"""Upserted tables and continuous ingest: what is rewritten, what readers see, replays and competing writers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.session import new_path
from larder.sources import files, snapshots
from larder.streaming import ingest

SCHEMA = "k string, day date, v double, at int"
DAY = dt.date(2001, 2, 3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table_of(spark, n=40, buckets=8):
    folder = new_path(spark, "snapshot-test")
    rows = [(f"k{i}", DAY, float(i), 0) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    snapshots.create(spark, folder, df.schema, ["k"], buckets)
    assert rows_of(snapshots.read(spark, folder)) == []
    assert snapshots.upsert(folder, df) == 1
    return folder, rows


def test_one_key_rewrites_one_bucket(spark):
    folder, rows = table_of(spark)
    before = snapshots.manifest(spark, folder)["folders"]
    snapshots.upsert(folder, spark.createDataFrame([("k7", DAY, 70.0, 1), ("new", None, None, 1)], SCHEMA).where("k = 'k7'"))
    after = snapshots.manifest(spark, folder)["folders"]
    assert sum(before[b] != after[b] for b in after) == 1 and before.keys() == after.keys()
    assert rows_of(snapshots.read(spark, folder)) == sorted([r for r in rows if r[0] != "k7"] + [("k7", DAY, 70.0, 1)], key=repr)
    assert rows_of(snapshots.read(spark, folder, 1)) == sorted(rows, key=repr)
    assert rows_of(snapshots.read(spark, folder, 0)) == []
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, folder, 9)
    with pytest.raises(FileExistsError):
        snapshots.create(spark, folder, spark.createDataFrame([], SCHEMA).schema, ["k"])


def test_newest_by_recency_stays(spark):
    folder, _ = table_of(spark, 3)
    new = spark.createDataFrame([("k0", DAY, 5.0, 3), ("k0", DAY, 6.0, 2), ("k1", DAY, 7.0, -1), (None, DAY, 8.0, 1)], SCHEMA)
    snapshots.upsert(folder, new, ["at", "v"])
    assert rows_of(snapshots.read(spark, folder)) == sorted(
        [("k0", DAY, 5.0, 3), ("k1", DAY, 1.0, 0), ("k2", DAY, 2.0, 0), (None, DAY, 8.0, 1)], key=repr)


def test_a_batch_that_comes_again_changes_nothing(spark):
    folder, _ = table_of(spark)
    new = spark.createDataFrame([("k1", DAY, 9.0, 1)], SCHEMA)
    version = snapshots.upsert(folder, new, source="s", batch=4)
    again = new.withColumn("v", F.lit(100.0))
    assert snapshots.upsert(folder, again, source="s", batch=4) == version == snapshots.manifest(spark, folder)["version"]
    assert snapshots.upsert(folder, again, source="other", batch=0) == version + 1
    assert snapshots.upsert(folder, new.limit(0)) == version + 1


def test_readers_do_not_see_an_unfinished_write_and_writers_do_not_lose_one(spark, monkeypatch):
    folder, _ = table_of(spark)
    publish, calls = snapshots._publish, []

    def interrupted(session, where, table):
        calls.append(table["version"])
        if len(calls) == 1:  # while this writer is about to publish, another one does
            assert snapshots.manifest(session, folder)["version"] == 1
            monkeypatch.setattr(snapshots, "_publish", publish)
            snapshots.upsert(folder, spark.createDataFrame([("k2", DAY, 22.0, 1)], SCHEMA))
            monkeypatch.setattr(snapshots, "_publish", interrupted)
        return publish(session, where, table)

    monkeypatch.setattr(snapshots, "_publish", interrupted)
    assert snapshots.upsert(folder, spark.createDataFrame([("k3", DAY, 33.0, 1)], SCHEMA)) == 3
    assert calls == [2, 3]
    values = {r.k: r.v for r in snapshots.read(spark, folder).collect()}
    assert (values["k2"], values["k3"], len(values)) == (22.0, 33.0, 40)


def test_vacuum_keeps_what_the_newest_versions_name(spark):
    folder, _ = table_of(spark)
    for i in range(3):
        snapshots.upsert(folder, spark.createDataFrame([("k1", DAY, float(i), 1)], SCHEMA))
    want = rows_of(snapshots.read(spark, folder))
    snapshots.vacuum(spark, folder, keep=1)
    assert rows_of(snapshots.read(spark, folder)) == want
    assert len(files.children(spark, f"{folder}/data")) == 2  # the first load and the last change
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, folder, 1)


def test_ingest_restarts_and_replays(spark):
    folder, _ = table_of(spark, 5)
    uploads, checkpoint = new_path(spark, "uploads"), new_path(spark, "checkpoint")

    def arrive(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(uploads)

    def run(where=checkpoint):
        ingest.ingest(spark, uploads, snapshots.read(spark, folder).schema, folder, where, ["at"], only="v IS NOT NULL")

    arrive(("k1", DAY, 11.0, 5), ("k1", DAY, 12.0, 4), (None, DAY, 1.0, 9), ("k2", DAY, None, 9))
    run()
    first = snapshots.manifest(spark, folder)
    assert list(first["batches"].values()) == [0]
    run()
    assert snapshots.manifest(spark, folder)["version"] == first["version"]
    arrive(("k1", DAY, 13.0, 3), ("k9", DAY, 9.0, 1))  # the first is older than what the table has
    run()
    values = {r.k: r.v for r in snapshots.read(spark, folder).collect()}
    assert values == {"k0": 0.0, "k1": 11.0, "k2": 2.0, "k3": 3.0, "k4": 4.0, "k9": 9.0}
    arrive(("k0", DAY, 10.0, 1),)
    run(new_path(spark, "lost-checkpoint"))  # all files come again, and a new one
    assert {r.k: r.v for r in snapshots.read(spark, folder).collect()} == values | {"k0": 10.0}
