"""Golay keys by exhaustion, fingerprints and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from larder.llm import golay, simhash

FOLDER = "/root/testdata/sf0.001"


def test_code_is_perfect():
    assert (golay.NUMBER >= 1).all()
    weights = np.bitwise_count(golay.PATTERNS[:, 0].astype(np.uint64))
    assert dict(Counter(weights.tolist())) == {0: 1, 1: 23, 2: 253, 3: 1771}
    assert ((golay.NUMBER == 6) == (weights == 3)).all() and ((golay.NUMBER == 1) == (weights < 3)).all()


def test_segments_one_bit_apart_share_the_nearest_index():
    all_segments = np.arange(1 << 16)
    index, _ = golay.near_indices(all_segments)
    for bit in range(16):
        other, number = golay.near_indices(all_segments ^ 1 << bit)
        valid = np.arange(6) < number[:, None]
        assert ((other == index[:, :1]) & valid).any(axis=1).all()


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes):
    """nodes: (id, fingerprint); component name per position."""
    fps = np.array([f for _, f in nodes], np.uint64)
    label = list(range(len(nodes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    groups = {}
    for i, (id_, _) in enumerate(nodes):
        groups.setdefault(root(i), []).append(id_)
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return [name[root(i)] for i in range(len(nodes))]


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    nodes = [(d, brute_fingerprint(t)) for d, t in docs]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(nodes, brute_components(nodes)))
    got = sorted(tuple(r) for r in simhash.op4_simhash(spark, FOLDER).collect())
    assert got == want
    assert len({c for *_, c in got}) < len(got)


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_links_of_dense_clusters(spark, block):
    rng = random.Random(block)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in (rng.getrandbits(64), 0):
        fps |= {center ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for _ in range(250)}
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= 1 << rng.randrange(64) | 1 << rng.randrange(64) | 1 << rng.randrange(64)
        fps.add(chain)
    nodes = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = np.array([f for _, f in nodes], np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.star_components(simhash.links(frame, block=block)).collect()
    root = {r.node: r.root for r in found}
    got, want = {}, {}
    for f, w in zip(signed, brute_components(nodes)):
        got.setdefault(root.get(f, f), set()).add(f)
        want.setdefault(w, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


EDGE = [(5, None), (3, ""), (None, " \n"), (7, "one two"), (8, "One  TWO"), (9, "É é"), (10, "w " * 90_000),
        (10, "w " * 90_000), (None, "only nameless rows here"), (11, "a b c d"), (11, "e f g h")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(t, 0, i) for i, t in EDGE], "text string, fp int, doc_id long")
    found = simhash.components(docs.select("doc_id", "text")).collect()
    nodes = [(d, brute_fingerprint(t)) for d, t in EDGE]
    want = sorted(((d, f, c) for (d, f), c in zip(nodes, brute_components(nodes))), key=repr)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found), key=repr) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in kept.collect())) == [0, 3, 7, 9, 10, 11, 11]
    assert simhash.components(docs.select("doc_id", "text").limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []
