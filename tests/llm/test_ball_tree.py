"""Ranked search against scoring every document, and the bounds of the balls against their documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import ball_tree as op

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    docs = [(d, words) for d, t in docs if (words := split(t))]
    n_docs, n_terms = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, words in docs for t in set(words))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text in items:
        terms, scored = Counter(split(text)), []
        for d, words in docs:
            tf, m = Counter(words), 25 + 75 * len(words) * n_docs // n_terms
            score = sum(n * weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, n in terms.items() if t in tf)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (*x[:2], x[2] or 0))[:top])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def read(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


def test_query_on_whole_table(spark):
    want = brute(read(spark, "documents", "doc_id", "text"), read(spark, "benchmark", "item_id", "text"))
    assert result(op.op12_lexical_search(spark, FOLDER)) == want


def block(seed, n=300, terms=400):
    rng = random.Random(seed)
    docs, vocabulary = [], {i: i for i in range(terms)}
    for d in range(n):
        if docs and rng.random() < 0.4:  # copies and near copies
            _, ids, impacts = rng.choice(docs)
            impacts = impacts.copy()
            impacts[rng.randrange(len(impacts))] = rng.randint(1, 900_000)
        else:
            ids = np.array(rng.sample(range(terms), rng.randint(1, 30)), np.int64)
            impacts = np.array([rng.randint(1, 900_000) for _ in ids], np.int64)
        docs.append((d, ids, impacts))
    return op.BallTree(docs, vocabulary, leaf=4, fan=4), docs


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.tuples(st.integers(0, 420), st.integers(0, 14_000)), min_size=1, max_size=12))
def test_search_equals_scoring_all(seed, item):
    tree, docs = block(seed % 40)
    item = dict(item)
    found, _ = tree.search(list(item), np.array(list(item.values()), np.int64))
    scores = sorted((-sum(item.get(t, 0) * v for t, v in zip(ids.tolist(), vals.tolist())), d) for d, ids, vals in docs)
    assert found == [(-s, d) for s, d in scores[:10] if s < 0]


def test_bounds_hold_and_prune():
    tree, _ = block(7, n=2000, terms=3000)
    rng, leaves = random.Random(1), []
    dense = np.zeros(3000, np.int64)

    def check(ball, ids, weights):
        for limit, child in zip(tree.bounds(ball, ids, weights), ball.children):
            inside = op.Ball(child.first, child.end, [])
            assert limit >= tree.scores(inside, dense).max() and (limit > 0) == (tree.scores(inside, dense).max() > 0)
            if child.children:
                check(child, ids, weights)

    for _ in range(20):
        ids = np.array(sorted(rng.sample(range(3000), 8)), np.int64)
        weights = np.array([rng.randint(1, 14_000) for _ in ids], np.int64)
        dense[ids] = weights
        check(tree.root, ids, weights)
        dense[ids] = 0
        leaves.append(tree.search(ids.tolist(), weights)[1])
    assert sum(leaves) < 0.3 * 20 * 2000 / tree.leaf


EDGE_DOCS = [(1, None), (2, ""), (3, " .,! "), (4, "alpha beta"), (5, "Alpha, BETA"), (None, "alpha beta"), (6, "É é alpha"), (7, "beta " * 40_000),
             (8, "alpha beta"), (8, "alpha beta"), (9, "gamma")]
EDGE_ITEMS = [(1, "alpha"), (1, "alpha beta beta"), (2, None), (3, "!"), (4, "unseen"), (None, "é"), (5, "beta gamma " * 300)]


@pytest.mark.parametrize("size", [op.BLOCK_DOCS, 2])
@pytest.mark.parametrize("share", [op.FLOOR_SHARE, 2])
def test_edge_rows(spark, monkeypatch, size, share):
    monkeypatch.setattr(op, "QUERY_TERMS", size)
    docs = spark.createDataFrame([(t, 0, i, "x") for i, t in EDGE_DOCS], "text string, q int, doc_id long, bytes string").repartition(2)
    items = spark.createDataFrame([(t, 1, i) for i, t in EDGE_ITEMS], "text string, q int, item_id long")
    assert result(op.search(docs, items, floor_share=share, block_docs=size)) == brute(EDGE_DOCS, EDGE_ITEMS)
    assert result(op.search(docs, items, top=2, floor_share=share, block_docs=size)) == brute(EDGE_DOCS, EDGE_ITEMS, 2)


def test_empty_tables(spark):
    docs = spark.createDataFrame(EDGE_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")
    assert op.search(docs.limit(0), items).collect() == []
    assert op.search(docs, items.limit(0)).collect() == []
