"""Packing: exact cover, room, balance, and the registered query against whole-text encoding."""

import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import packing

FOLDER = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_assign_covers_every_token_once(lengths):
    pieces = packing.assign(lengths, 16)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for i, start, n, s, offset in pieces:
        by_doc[i].append((start, n))
        by_seq[s].append((offset, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == n
    for members in by_seq.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 16 and at & (at - 1) == 0


def test_costs_are_balanced():
    lengths = [1500] * 20 + [300] * 40 + [100] * 60
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.assign(lengths, 2048):
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = sorted(cost.values())[-20:]
    assert max(full) / min(full) < 1.25


def brute(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs]


def verify(pieces, docs):
    want = sorted(brute(docs), key=repr)
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    by_id = dict(want)
    assert len(by_id) == len(want)
    for doc_id, ids in want:
        at = 0
        for p in sorted(got.pop(doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(array("I", ids[at:at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
    assert not got
    used = defaultdict(list)
    for p in pieces:
        used[p.sequence_id].append((p.offset, p.length))
    total = [sum(n for _, n in m) for m in used.values()]
    for members in used.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 2048
    assert np.all(np.bitwise_count(np.array(total)) == 1)


def test_query_on_whole_table(spark):
    pieces = packing.op7_packing(spark, FOLDER).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    verify(pieces, docs)


def test_edge_rows(spark):
    data = [(1, None), (2, ""), (None, "a b"), (4, "  \n"), (5, "word " * 30_000), (6, "x\n\ny  z"), (7, "x")]
    docs = spark.createDataFrame([(9, t, i, "n") for i, t in data], "length int, text string, doc_id long, ids string")
    verify(packing.piece_rows(docs).collect(), data)
    twice = packing.piece_rows(docs.unionAll(docs)).collect()
    assert sum(p.length for p in twice) == 2 * sum(len(ids) for _, ids in brute(data))
    assert packing.piece_rows(docs.limit(0)).collect() == []
