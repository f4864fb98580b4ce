"""The two classifiers: gradients, features, held-out accuracy, and rows at the edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import quality, toxicity
from larder.llm.training import fitted, held_out, labelled_sample

SMALL, FOLDER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def brute_buckets(text):
    padded = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in f" {text.lower()} ")
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(padded) - n + 1):
            gram = padded[i:i + n]
            if " " not in gram[1:-1]:
                h = 0
                for k, c in enumerate(gram):
                    h = ord(c) if not k else (h * int(toxicity.STEP) + ord(c)) % 2**64
                out.add((h + n) * int(toxicity.MIX) % 2**64 >> 64 - toxicity.BITS)
    return out


@pytest.mark.parametrize("text", ["", "a", "An idiot!!", "É\nß stupid-x 12345678", "  ", "\U0001f600 ab"])
def test_buckets(text):
    assert set(toxicity.buckets(text).tolist()) == brute_buckets(text)


def test_distinct():
    rng, distinct = np.random.default_rng(0), toxicity.Distinct(50)
    for n in (0, 1, 30, 200):
        values = rng.integers(0, 50, n)
        assert sorted(distinct(values).tolist()) == sorted(set(values.tolist()))


def test_minimise_a_quadratic():
    a = np.diag([1.0, 10.0, 100.0])
    x = toxicity.minimise(lambda x: (x @ a @ x / 2 - x.sum(), a @ x - 1), np.zeros(3), rounds=200)
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-3)


def test_network_gradients():
    rng = np.random.default_rng(1)
    p = quality.initial(rng)
    x, first, bag = quality.bags([rng.standard_normal((n, quality.N_FEATURES)) for n in (1, 3, 5)])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        s = quality.forward(p, x, first, bag)["p"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, grad in quality.gradients(p, x, first, bag, y).items():
        flat = p[name].reshape(-1)
        for at in rng.integers(0, len(flat), 4):
            kept, flat[at] = flat[at], flat[at] + 1e-5
            up = loss()
            flat[at] = kept - 1e-5
            down = loss()
            flat[at] = kept
            assert abs((up - down) / 2e-5 - grad.reshape(-1)[at]) < 1e-6


def test_passages_cover_the_text():
    words = [f"w{i}," for i in range(200)]
    rows = quality.passages("  " + " ".join(words))
    assert len(rows) == 4 and np.allclose(rows[:, :quality.N_PAIRS].sum(1), 1)
    assert np.allclose(rows[:, quality.N_PAIRS], 1) and (quality.passages("!! " * 64)[0] != rows[0]).any()
    assert len(quality.passages("")) == len(quality.passages(" \n")) == 1
    # Bounded pieces give the same rows.
    whole, quality.PIECE_BYTES = quality.PIECE_BYTES, 300
    try:
        assert np.allclose(quality.passages("  " + " ".join(words)), rows)
    finally:
        quality.PIECE_BYTES = whole


def auc(y, s):
    rank = np.empty(len(s))
    rank[np.argsort(s, kind="stable")] = np.arange(len(s))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize("name, label, modulus, remainder, threshold, floor", [
    ("op6_toxicity", "toxic", 4, 2, 0.3, 0.97), ("op10_quality", "quality", 3, 1, 0.5, 0.99)])
def test_held_out_accuracy(spark, name, label, modulus, remainder, threshold, floor):
    from larder.llm.queries import QUERIES
    out = QUERIES[name](spark, FOLDER)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = out.join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    held = [r for r in rows if r.held_out and r.y is not None]
    y, s = np.array([r.y for r in held]), np.array([r.score for r in held])
    assert auc(y, s) > floor


ROWS = [(1, None), (2, ""), (None, "idiot here"), (3, "long text " * 40_000), (4, "same"), (4, "same"), (5, "!!! " * 70)]


@pytest.mark.parametrize("run", [
    lambda d, lab: toxicity.toxicity(d, lab).select("doc_id", "score"),
    lambda d, lab: quality.quality(d, lab).select("doc_id", "score")])
def test_edge_rows(spark, run):
    docs = spark.createDataFrame([(t, 1, i, 0.5) for i, t in ROWS], "text string, label int, doc_id long, score double")
    kind = "toxic int, text string, quality int, doc_id long"
    none = spark.createDataFrame([], kind)
    assert {round(r.score, 6) for r in run(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, "t", 1, i) for i in (1, 2, 3)], kind)
    assert len({round(r.score, 6) for r in run(docs, one).collect()}) == 1
    mixed = spark.createDataFrame([(i % 2, None, i % 2, i) for i in range(9)] + [(None, "t", None, 5), (1, "t", 1, None),
                                                                               (0, "t", 0, 3), (7, "t", 7, 2)], kind)
    found = run(docs, mixed).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 4}) == 1
    assert run(docs.limit(0), mixed).collect() == []


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] * 2, "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", held_out(4, 2), 40).collect()
    assert len(rows) == 40
    assert all(zlib.crc32(r.text.split()[1].encode()) % 4 != 2 for r in rows)
    sample = labelled_sample(docs, labels, "toxic", held_out(4, 2), 1000)
    assert fitted(sample, lambda texts, y: str(len(texts)).encode()) == str(
        sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(300))).encode()
