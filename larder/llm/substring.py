"""Substring deduplication: seed on winnowed anchors, extend both ways, keep maximal repeats.

Words are maximal runs without ASCII white space. A window is ``LENGTH`` consecutive words; a word goes
when a window over it also starts in a document with a smaller ``doc_id``. Windows are judged on the
input, so the order of removal does not matter.

* Seed: of the ``LENGTH - ANCHOR + 1`` word shingles of ``ANCHOR`` words in a window, the one with the
  least hash is its anchor. Equal windows choose equal anchors, so documents are joined on the anchors
  that at least two of them have; these are a fraction of all words.
* Extend: the windows that chose an anchor are its extensions, by every split of the other words over its left
  and right. Per anchor, occurrences are compared by 64-bit hashes of these windows, not word by word, and each
  learns which of them an earlier document has. Occurrences of an anchor meet in one task; those of an anchor with
  more than ``HOT`` are salted by document, and what a salt cannot decide is decided in a second, small step.
* Maximal: a document unites its repeated windows into maximal spans of at least ``LENGTH`` words.

No pair of documents is formed and no group is capped. Equal windows are told by 64-bit hashes of their
words, compared only among occurrences of one anchor.

Defined results: null and empty texts have no words; documents shorter than a window stay whole; a null
``doc_id`` is neither smaller nor larger than any other; rows that repeat an id are judged one by one and
do not remove each other's words (what an earlier document has is said per id and window, so they can share it); an empty table gives an empty result; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm.base import query, table, utf8
from larder.session import stage

LENGTH, ANCHOR = 13, 4
HOT = 10_000
KEYS_AT_ONCE = 1 << 18

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(words: np.ndarray, n: int, step: np.uint64) -> np.ndarray:
    """A polynomial hash of every ``n`` consecutive word hashes."""
    m = len(words) - n + 1
    out = words[:m].copy()
    for j in range(1, n):
        out *= step
        out += words[j:j + m]
    return out


def windows(words: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Per window: the hash of its anchor and of all its words."""
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    short = shingle_hashes(hashes, anchor, MIX)
    short ^= short >> np.uint64(32)
    short *= STEP
    short ^= short >> np.uint64(29)
    chosen = np.lib.stride_tricks.sliding_window_view(short, length - anchor + 1).min(axis=1)
    return chosen.view(np.int64), shingle_hashes(hashes, length, STEP).view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id): the distinct anchors of each document."""
    def run(batches):
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            found = [np.unique(windows(t.split())[0]) for t in batch.column(1).to_pylist()]
            ids = np.repeat(doc_ids, [len(f) for f in found])
            for at in range(0, len(ids), KEYS_AT_ONCE):
                part = slice(at, at + KEYS_AT_ONCE)
                if at == 0:
                    flat = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(flat[part]), pa.array(ids[part])], names=["anchor", "doc_id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", utf8("text").alias("bytes")).mapInArrow(
        run, "anchor long, doc_id long")


def extensions(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(anchor, salt, doc_id, keys): the distinct windows of a document that chose a shared anchor.

    The salt is -1 for anchors that need none.
    """
    def run(batches):
        held, n_keys = [], 0

        def flush():
            anchor, salt, doc_id, n, keys = (np.concatenate(c) for c in zip(*held))
            offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(salt), pa.array(doc_id), pa.ListArray.from_arrays(offsets, pa.array(keys))],
                names=["anchor", "salt", "doc_id", "keys"])

        for batch in batches:
            for doc_id, text, cold, hot in zip(*(c.to_pylist() for c in batch.columns)):
                if not cold and not hot:
                    continue
                salts = {h["anchor"]: h["salts"] for h in hot or ()}
                chosen, keys = windows(text.split())
                mask = np.isin(chosen, np.array([*(cold or ()), *salts], np.int64))
                pairs = np.unique(np.stack([chosen[mask], keys[mask]], axis=1), axis=0)
                if not len(pairs):
                    continue
                anchor, n = np.unique(pairs[:, 0], return_counts=True)
                number = xxh64_intdigest(str(doc_id))
                salt = np.array([number % salts[a] if a in salts else -1 for a in anchor.tolist()], np.int64)
                held.append((anchor, salt, np.full(len(anchor), doc_id), n, pairs[:, 1]))
                n_keys += len(pairs)
                if n_keys >= KEYS_AT_ONCE:
                    yield flush()
                    held, n_keys = [], 0
        if held:
            yield flush()

    of_doc = seeds.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("salts") == 1, F.col("anchor"))).alias("cold"),
        F.collect_set(F.when(F.col("salts") > 1, F.struct("anchor", "salts"))).alias("hot"))
    return docs.join(of_doc, "doc_id", "left").select("doc_id", "bytes", "cold", "hot").mapInArrow(
        run, "anchor long, salt long, doc_id long, keys array<long>")


def earlier(found: DataFrame) -> DataFrame:
    """(doc_id, whole, keys): anchors all of whose windows an earlier document has, or else such windows.

    Occurrences of an anchor and salt meet in one task, where every window but its first document's is
    decided. The first of a salted anchor's window may still be late; these are left open, one per salt,
    and decided among themselves.
    """
    names = ["doc_id", "whole", "keys", "open"]

    def lists(n, keys):
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(keys))

    def judge(anchor, salt, doc_id, n, keys):
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((keys, salt[row], anchor[row]))
        group = np.stack([anchor[row], salt[row], keys])[:, order]
        start = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])
        first = np.minimum.reduceat(doc_id[row][order], start)
        late = np.empty(len(keys), bool)
        late[order] = np.repeat(first, np.diff(np.r_[start, len(keys)])) < doc_id[row][order]
        n_late = np.bincount(row, late, len(n)).astype(np.int64)
        some, whole = n_late > 0, n_late == n
        # Rows that share a doc_id share what is said of it: an anchor is whole in all of them or in none.
        order = np.lexsort((doc_id, salt, anchor))
        place = np.stack([anchor, salt, doc_id])[:, order]
        first_row = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)])
        if len(first_row) < len(n):
            all_whole = np.minimum.reduceat(whole[order], first_row)
            whole[order] = np.repeat(all_whole, np.diff(np.r_[first_row, len(n)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_id[some]), pa.array(anchor[some], mask=~whole[some]),
             lists(np.where(whole, 0, n_late)[some], keys[late & ~whole[row]]), pa.nulls(int(some.sum()), pa.int64())],
            names=names)
        left = (salt >= 0) & ~whole
        if left.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id[left]), pa.nulls(int(left.sum()), pa.int64()),
                 lists((n - n_late)[left], keys[~late & left[row]]), pa.array(anchor[left])], names=names)

    def run(batches):
        held = None
        for batch in batches:
            keys = batch.column(3)
            rows = [*(batch.column(i).to_numpy() for i in range(3)),
                    keys.value_lengths().to_numpy().astype(np.int64), keys.flatten().to_numpy()]
            if held:
                rows = [np.concatenate(pair) for pair in zip(held, rows)]
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
            cut = int(change[-1]) + 1 if len(change) else 0
            at = int(rows[3][:cut].sum())
            if cut:
                yield from judge(*(r[:cut] for r in rows[:4]), rows[4][:at])
            held = [*(r[cut:] for r in rows[:4]), rows[4][at:]]
        if held and len(held[0]):
            yield from judge(*held)

    grouped = found.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    judged = grouped.mapInArrow(run, "doc_id long, whole long, keys array<long>, open long")
    open_ = judged.where("open IS NOT NULL").select("doc_id", "open", F.explode("keys").alias("key"))
    first = F.min("doc_id").over(Window.partitionBy("open", "key"))
    late = open_.withColumn("first", first).where("first < doc_id").select(
        "doc_id", F.lit(None).cast("long").alias("whole"), F.array("key").alias("keys"))
    return judged.where("open IS NULL").drop("open").unionByName(late)


def marked_words(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Per document: n_words, n_removed, the removed spans of words and the text that is kept."""
    def judge(text, whole, keys):
        words = text.split()
        gone = np.zeros(len(words) + 1, np.int64)
        if whole or keys:
            chosen, key = windows(words)
            at = np.flatnonzero(np.isin(chosen, np.array(whole, np.int64)) | np.isin(key, np.array(keys, np.int64)))
            np.add.at(gone, at, 1)
            np.add.at(gone, at + LENGTH, -1)
        gone = np.cumsum(gone[:-1]) > 0
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
        at, kept = 0, []
        for a, b in zip(edges[::2], edges[1::2]):
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), len(words) - len(kept), edges, b" ".join(kept)

    def run(batches):
        for batch in batches:
            out = [judge(t, w or (), k or ()) for t, w, k in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 4, types))],
                names=["doc_id", "n_words", "n_removed", "edges", "kept"])

    of_doc = hits.groupBy("doc_id").agg(F.collect_list("whole").alias("whole"),
                                        F.flatten(F.collect_list("keys")).alias("keys"))
    return docs.join(of_doc, "doc_id", "left").select("doc_id", "bytes", "whole", "keys").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, edges array<int>, kept binary")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, edges (first and end of each removed span, in words), kept (UTF-8)."""
    docs = docs.select("doc_id", "text")
    found = anchors(docs)
    salts = F.ceil(F.col("count") / hot).cast("int").alias("salts")
    # Staged, so that the join with a hot anchor can be split.
    shared = stage(found.groupBy("anchor").count().where("count > 1").select("anchor", salts), "shared-anchors")
    seeds = found.join(shared, "anchor")
    texts = docs.select("doc_id", utf8("text").alias("bytes"))
    return marked_words(texts, earlier(extensions(texts, seeds)))


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
