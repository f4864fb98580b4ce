"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's word shingles.
Documents link when their fingerprints differ in at most three bits; groups are the connected
components. Equal fingerprints are one node from the start.

Candidate search: a fingerprint has four segments of 16 bits. If two differ in three bits at most, some
segment i is equal and segment i + 1 (cyclically) differs in one bit at most. Decoding a segment as a
Golay word gives the indices of all codewords within four bits, one or six of them; among these is the
nearest codeword of any segment one bit away. So the key (i, segment i, codeword index) of one
fingerprint's nearest codeword is among the keys of the other: no link is lost.

Rows of a key meet in a task, sorted. Keys with more than ``BLOCK`` rows are dealt as pairs of blocks,
so a task never holds more than two blocks; every pair of a key is compared in numpy, and only a
spanning forest of the links leaves the task.

Defined results: a null or empty text has fingerprint zero and links like any other; a text with fewer
words than a shingle is one shingle; a null ``doc_id`` is never a component's name unless no member has
an id; rows that repeat an id are separate rows with one fingerprint each; an empty table gives an
empty result; other columns are not read.
"""

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm.base import marked, query, table, utf8
from larder.llm.components import star_components
from larder.llm.golay import near_indices
from larder.session import stage

SHINGLE, SEED = 3, 42
DISTANCE = 3
BLOCK = 4096
PAIRS = 1 << 21      # compared at a time
PENDING = 1 << 16    # links held before they are contracted


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(shingle, len(words)) - 1:]
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, last)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with the fingerprint ``fp`` as a signed long."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names=[*others, "fp"])

    read = docs.select(*others, utf8("text").alias("__bytes"))
    schema = read.select(*others, F.lit(0).cast("long").alias("fp")).schema
    return read.mapInArrow(run, schema)


def keys(fps: DataFrame) -> DataFrame:
    """(key, fp, nearest) of each fingerprint; ``nearest`` marks the key of the nearest codeword."""
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(4):
                exact = fp.view(np.uint64) >> np.uint64(16 * i) & np.uint64(0xFFFF)
                fuzzy = fp.view(np.uint64) >> np.uint64(16 * ((i + 1) % 4)) & np.uint64(0xFFFF)
                index, number = near_indices(fuzzy.astype(np.int64))
                key = (i << 28 | exact.astype(np.int64) << 12)[:, None] | index
                valid = np.arange(6) < number[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[valid]), pa.array(np.repeat(fp, number)),
                     pa.array(np.broadcast_to(np.arange(6) == 0, valid.shape)[valid])], names=["key", "fp", "nearest"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, nearest boolean")


class Forest:
    """Disjoint sets of fingerprints."""

    def __init__(self):
        self.parent = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def link(self, pairs: np.ndarray) -> None:
        for a, b in np.unique(pairs, axis=0).tolist():
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def contracted(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For links between positions below ``n``: the smallest position of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            return label


def compare(group: np.ndarray, fp: np.ndarray, nearest: np.ndarray, distance: int, forest: Forest) -> None:
    """Link the fingerprints of each run of equal groups, every nearest one against all others."""
    edges = np.flatnonzero(np.diff(group)) + 1
    first, end = np.r_[0, edges], np.r_[edges, len(group)]
    run_of = np.repeat(np.arange(len(first)), end - first)
    left = np.flatnonzero(nearest & ((end - first) > 1)[run_of])
    width = (end - first)[run_of[left]]
    stops = np.cumsum(width)
    at = 0
    while at < len(left):
        # As many left rows as give about PAIRS pairs; a single row has 2 * BLOCK partners at most.
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS)))
        rows = np.repeat(left[at:to], width[at:to])
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(width[at:to]) - width[at:to], width[at:to])
        other = first[run_of[rows]] + offset
        near = (np.bitwise_count((fp[rows] ^ fp[other]).view(np.uint64)) <= distance) & (fp[rows] != fp[other])
        a, b = rows[near], other[near]
        if len(a):
            used, both = np.unique(np.r_[a, b], return_inverse=True)
            label = contracted(both[:len(a)], both[len(a):], len(used))
            forest.link(np.stack([fp[used], fp[used[label]]], axis=1))
        at = to


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): spanning links of distinct fingerprints ``fp`` within ``distance`` bits (3 at most)."""
    keyed = keys(fps)
    large = keyed.groupBy("key").count().where(F.col("count") > block)
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (keyed.join(large, "key", "left").withColumn("blocks", blocks).withColumn("own", own)
             .select("key", "fp", "nearest", "own",
                     F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     "fp", "nearest"))

    def run(batches):
        forest, held = Forest(), None
        for batch in batches:
            key, low, high, fp, nearest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = [np.concatenate([h, c]) if held else c for h, c in
                    zip(held or [None] * 5, (key, low, high, fp, nearest.astype(bool)))]
            change = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)
            cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            if cut:
                compare(np.cumsum(np.r_[0, change[:cut - 1]]), rows[3][:cut], rows[4][:cut], distance, forest)
            held = [r[cut:] for r in rows]
        if held:
            compare(np.zeros(len(held[0]), int), held[3], held[4], distance, forest)
        nodes = [x for x in forest.parent if forest.root(x) != x]
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], names=["a", "b"])

    grouped = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return grouped.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` without its text, with ``fp`` and the name of its component, the smallest doc_id in it."""
    rows = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = star_components(links(nodes, distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "rooted")
    named = stage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    return rows.join(rooted.join(named, "root").select("fp", "component_id", "root"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each component, with all columns."""
    placed, at = marked(docs, "simhash-texts")
    found = stage(components(placed.select("doc_id", "text", F.col(at).alias("place"))), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    best = stage(found.groupBy("root").agg(F.min(rank).alias("best")), "best")
    dropped = found.join(best, "root").where("place <> best.place").select(F.col("place").alias(at))
    return placed.join(dropped, at, "left_anti").drop(at)


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
