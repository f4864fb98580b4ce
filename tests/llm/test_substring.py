"""Substring deduplication against a table of all windows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.llm import substring

FOLDER = "/root/testdata/sf0.001"


def brute(docs):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, words in split:
        for i in range(len(words) - 12) if d is not None else ():
            w = tuple(words[i:i + 13])
            first[w] = min(first.get(w, d), d)
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - 12) if d is not None else ():
            if first[tuple(words[i:i + 13])] < d:
                gone[i:i + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    df = df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in substring.op1_substring_dedup(spark, FOLDER).collect()), key=repr)
    assert got == brute(docs)
    assert any(0 < r[2] < r[1] for r in got)


def edge_rows():
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    mixed = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(i, mixed(rng.randint(5, 60))) for i in range(40)]
    rows += [(100 + i, f"{mixed(4)} {passage} {mixed(6)}") for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (None, passage), (None, passage), (203, "ha " * 400),
             (204, "ha " * 14), (205, passage), (205, passage), (205, "other text " * 20), (206, "other text " * 20),
             (207, f"{passage} long " + mixed(60_000)), (208, " ".join(f"p{i}" for i in range(12))),
             (209, "É x " * 20), (210, "É x " * 20)]
    return rows


@pytest.mark.parametrize("hot", [substring.HOT, 3])
def test_edge_rows(spark, hot):
    rows = edge_rows()
    docs = spark.createDataFrame([(t, 1, i) for i, t in rows], "text string, kept int, doc_id long").repartition(4)
    assert result(substring.remove_repeats(docs, hot=hot)) == brute(rows)


@pytest.mark.parametrize("hot", [substring.HOT, 3])
def test_repeated_ids(spark, hot):
    rng = random.Random(9)
    rows = [(rng.randrange(60), " ".join(rng.choice("ab") for _ in range(rng.randint(10, 40)))) for _ in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(substring.remove_repeats(docs, hot=hot)) == brute(rows)


def test_spans_are_maximal(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(40)))), (2, "x " + " ".join(map(str, range(5, 35))) + " y")],
                                 "doc_id long, text string")
    rows = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert rows[1].edges == [] and rows[2].edges == [1, 31] and bytes(rows[2].kept) == b"x y"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(docs).collect() == []
