"""Exact deduplication against a brute-force grouping."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from larder.llm import dedup

SCHEMA = "text string, extra int, doc_id long, digest string"


def brute(rows):
    groups = {}
    for i, (text, _, doc_id, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((i, text or "", doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[2] is None, m[2] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[2], best[2], len(members), sha) for m in members]
    return sorted(out, key=repr)


CASES = [
    ("a b", 1, 5, "x"), ("ab", 1, 1, "x"), ("a\tb", 1, 3, "x"), ("a  b", 2, 9, None), ("a  b", 2, 7, None),
    (None, 1, 2, "x"), ("", 1, 4, "x"), (" \n", 1, None, "x"), ("é x", 1, 10, "x"),
    ("é  x", 1, 11, "x"), ("rep", 0, 12, "x"), ("rep", 0, 12, "x"), ("w" * 200_000, 1, 13, "x"),
    ("\x0b\x0cz", 1, None, "x"), ("z", 1, None, "x"),
]


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in df.collect()), key=repr)


def test_groups(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    got = dedup.exact_groups(docs)
    assert result(got) == brute(CASES)
    kept = got.groupBy("digest").agg(F.sum(F.col("kept").cast("int")).alias("n"))
    assert {r.n for r in kept.collect()} == {1}


def test_collisions_are_told_apart_by_full_bytes(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    got = dedup.exact_groups(docs, digest=lambda norm: F.length(norm).cast("string"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect() if r.doc_id) == sorted(
        x[:3] for x in brute(CASES) if x[0])


def test_several_batches_share_one_state(spark):
    docs = spark.createDataFrame(CASES, SCHEMA).repartition(5)
    assert result(dedup.exact_groups(docs, files_per_batch=1)) == brute(CASES)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert dedup.exact_groups(docs).collect() == []
    assert dedup.keep_one(docs).collect() == []


def test_keep_one_returns_whole_rows(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({x[3] for x in brute(CASES)})


@pytest.mark.parametrize("name", ["op2_exact_dedup"])
def test_registered(name):
    from larder.llm.queries import ORACLE, QUERIES
    assert name in QUERIES and name in ORACLE
