"""The stages against brute force on whole small tables, in order and alone."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from larder.session import stage
from tests.llm import test_dedup, test_decontaminate, test_packing, test_simhash

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_every_stage(spark):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for name, function in pipeline.STAGES:
        before = pairs(docs)
        docs = stage(function(spark, docs, FOLDER), f"test-{name}")
        if name == "packing":
            test_packing.verify(docs.collect(), before)
            break
        assert docs.columns == COLUMNS
        after = pairs(docs)
        assert set(after) <= set(before)
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            kept = {d for d, _ in after}
            good = [d in kept for d, _ in before if labels.get(d) == 1]
            bad = [d in kept for d, _ in before if labels.get(d) == 0]
            assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.4 * len(bad)
        elif name == "exact_dedup":
            groups = test_dedup.brute([(t, None, d, None) for d, t in before])
            assert sorted(d for d, _ in after) == sorted({g[1] for g in groups})
        elif name == "near_dedup":
            nodes = [(d, test_simhash.brute_fingerprint(t)) for d, t in before]
            assert sorted(d for d, _ in after) == sorted(set(test_simhash.brute_components(nodes)))
        else:
            bad = {r[0] for r in test_decontaminate.brute(before, bench) if r[5]}
            assert sorted(after) == sorted(x for x in before if x[0] not in bad)


ROWS = [(1, None), (2, ""), (None, "no id"), (None, "no  id"), (5, "word " * 50_000), (5, "word " * 50_000), (6, "a b c")]
# Names that the operators use themselves, and names that need quotes.
EXTRA = ["kept", "fp", "at", "__at", "place", "match", "__match", "__bytes", "score", "__score", "a b-c", "_metadata"]


@pytest.mark.parametrize("name, function", pipeline.STAGES)
def test_edge_rows(spark, name, function):
    schema = ", ".join(["doc_id long", "text string", "lang string", *(f"`{c}` int" for c in EXTRA)])
    docs = spark.createDataFrame([(i, t, None, *range(len(EXTRA))) for i, t in ROWS], schema)
    out = function(spark, docs, FOLDER)
    assert name == "packing" or out.columns == docs.columns
    rows = out.collect()
    if name == "exact_dedup":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 2, 5, 6] or sorted(r.doc_id or 0 for r in rows) == [0, 1, 5, 6]
    if name == "near_dedup":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 5, 6]
    if name == "decontamination":
        assert len(rows) == len(ROWS)
    assert function(spark, docs.limit(0), FOLDER).collect() == []


@pytest.mark.parametrize("function", [pipeline.exact, pipeline.near])
def test_rows_exploded_from_a_file_are_told_apart(spark, function):
    docs = stage(spark.createDataFrame([(i, f"text number {i} of many") for i in range(20)], "doc_id long, text string"), "once")
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert sorted(r.doc_id for r in function(spark, twice, FOLDER).collect()) == list(range(20))


def test_run(spark):
    out = pipeline.run(spark, FOLDER)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0
