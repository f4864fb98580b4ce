"""Huffman codes against plain Huffman, and exact round trips through the files."""

import heapq
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import token_files
from larder.llm.base import small_batches
from larder.llm.huffman import Code, code_lengths

FOLDER = "/root/testdata/sf0.001"


def plain_cost(counts):
    heap, total = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=40))
def test_lengths_are_optimal_and_limited(counts):
    counts = np.array(counts)
    used = int((counts > 0).sum())
    if used < 2:
        return
    wide = code_lengths(counts, 25)
    if wide.max() < 25:
        assert int((counts * wide).sum()) == plain_cost(counts.tolist())
    tight = code_lengths(counts, 6)
    assert tight.max() <= 6
    assert sum(2.0 ** -int(n) for n in tight if n) == 1
    assert ((tight > 0) == (counts > 0)).all()


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_stream_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 900)
    code = Code(code_lengths(np.bincount(ids, minlength=1000), 12))
    stream, offsets = code.encode(ids)
    assert (code.decode(stream, n, offsets) == ids).all()
    # A block in the middle decodes from its checkpoint alone.
    k = len(offsets) - 1
    assert (code.decode(stream, n - 256 * k, offsets[k:]) == ids[256 * k:]).all()


def test_too_many_symbols():
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)


def brute(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    out, at = [], 0
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = [tuple(r) for r in token_files.op3_token_files(spark, FOLDER).collect()]
    assert sorted(got) == brute(sorted(docs))


def test_edge_rows(spark):
    data = [(None, "no id"), (1, None), (2, ""), (3, "a b c"), (4, "Some longer " * 40_000), (7, "é ß!\t　x"),
            (9, "twice"), (9, "twice")]
    docs = spark.createDataFrame([(t, i, 3) for i, t in reversed(data)], "text string, doc_id long, start int")
    path = public_tokenizers.path("word_bpe_49k.json")
    read = token_files.read_files(token_files.write_tokens(docs, path, "dropped")).collect()
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read]
    assert sorted(got, key=lambda r: r[1]) == brute(data)
    empty = token_files.write_tokens(docs.limit(0), path, "dropped")
    assert token_files.read_files(empty).collect() == []


LIMITS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def limits(spark):
    return tuple(spark.conf.get(name, None) for name in LIMITS)


def test_small_batches_bound_the_bytes(spark):
    docs = spark.range(0, 64, numPartitions=1).selectExpr("repeat('word ', 40000) text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    before = limits(spark)
    with small_batches(spark, n_bytes=1 << 20):
        found = docs.mapInArrow(run, "n long, size long").collect()
    assert sum(r.n for r in found) == 64 and max(r.size for r in found) <= (1 << 20) + 210_000
    assert limits(spark) == before


def test_every_pass_over_rows_takes_small_batches(spark, monkeypatch):
    seen, stage, before = {}, token_files.stage, limits(spark)
    monkeypatch.setattr(token_files, "stage", lambda df, label: seen.update({label: limits(spark)}) or stage(df, label))
    token_files.write_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"),
                             public_tokenizers.path("word_bpe_49k.json"), "dropped")
    assert seen == dict.fromkeys(["token-ids", "token-manifest"], ("1024", str(4 << 20)))
    assert limits(spark) == before
