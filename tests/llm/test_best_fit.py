"""Best-fit packing: the plan against exhaustive matching and single-item best fit, and the query on a whole table."""

import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm import best_fit as op

FOLDER = "/root/testdata/sf0.001"


def unrolled(counts, capacity):
    """(sequence, offset, length) of every piece of a plan."""
    out, entries = [], op.planned(counts, capacity).tolist()
    for i, (length, first, sequence, each, offset) in enumerate(entries):
        end = entries[i + 1][1] if i + 1 < len(entries) and entries[i + 1][0] == length else counts[length]
        out += [(sequence + k // each, offset + k % each * length, length) for k in range(end - first)]
    return out


def checked(pieces, capacity):
    used = defaultdict(list)
    for sequence, offset, length in pieces:
        used[sequence].append((offset, length))
    for members in used.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return used


def one_by_one(counts, capacity):
    """The number of sequences when pieces are matched and fitted singly."""
    gaps = []
    large = sorted((n for n, c in counts.items() for _ in range(c) if 3 * n > capacity))
    while large:
        longer = large.pop()
        fits = [i for i, n in enumerate(large) if n + longer <= capacity]
        gaps.append(capacity - longer - (large.pop(fits[-1]) if fits else 0))
    for n in sorted((n for n, c in counts.items() for _ in range(c) if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 7), max_size=12))
def test_plan_covers_every_piece_and_equals_best_fit_piece_by_piece(counts):
    pieces = unrolled(counts, 24)
    assert Counter(length for *_, length in pieces) == Counter(counts)
    assert len(checked(pieces, 24)) == one_by_one(counts, 24)


def most_pairs(lengths, capacity):
    if not lengths:
        return 0
    first, *rest = lengths
    return max([most_pairs(rest, capacity)] + [
        1 + most_pairs(rest[:i] + rest[i + 1:], capacity) for i, n in enumerate(rest) if first + n <= capacity])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(9, 24), max_size=8))
def test_greedy_matching_is_the_largest(lengths):
    found = op.matched(Counter(lengths), 24)
    assert sum(n for _, partner, n in found if partner) == most_pairs(lengths, 24)


def test_few_sequences():
    counts = {n: 1 + 2000 // n for n in range(1, 1025)}
    total = sum(n * c for n, c in counts.items())
    assert len(checked(unrolled(counts, 1024), 1024)) <= 1.01 * -(-total // 1024)


def brute(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in docs]


def verify(pieces, docs):
    want = Counter()
    for doc_id, ids in brute(docs):
        first = len(ids) % 1024 or 1024
        ends = [min(first, len(ids)), *range(first + 1024, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            want[doc_id, i, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    used = checked([(p.sequence_id, p.offset, p.length) for p in pieces], 1024)
    assert len(used) <= 1.25 * -(-sum(p.length for p in pieces) // 1024) + 1


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    verify(op.op13_best_fit(spark, FOLDER).collect(), docs)


def test_edge_rows_and_sequences(spark):
    data = [(1, None), (2, ""), (None, "a b"), (4, "  \n"), (5, "word " * 30_000), (6, "x\n\ny  z"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame([(9, t, i, "n") for i, t in data], "length int, text string, doc_id long, part string")
    pieces = op.token_pieces(docs.repartition(3), public_tokenizers.path("byte_bpe_50k.json"))
    placed = op.placed(pieces)
    verify(placed.selectExpr("*", "crc32(ids) AS ids_crc32").collect(), data)
    by_sequence = {r.sequence_id: array("I", bytes(r.ids)) for r in op.sequences(placed).collect()}
    for p in placed.collect():
        assert by_sequence[p.sequence_id][p.offset:p.offset + p.length] == array("I", bytes(p.ids))
    assert op.placed(op.token_pieces(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).collect() == []
