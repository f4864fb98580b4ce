"""Token ids in compressed binary files, in ascending document order.

Whole texts are encoded once and staged; the counts of all ids give one length-limited canonical
Huffman code. The staged rows are sorted by range of (doc_id, text) and each range is written as one
file of independent blocks, so any block can be read alone. Layout, little-endian:

    file   := "HUFT" u32(size) zlib(code length per id, one byte each) block*
    block  := u32(size of the rest) u32(documents) u64(ids) u64(ids of earlier blocks in the file)
              u64(length of the bit stream) null flag per document (u8), doc_id per document (i64),
              ids per document (u64), bit offset of every 256th id (u64), bit stream

Files are written under a fresh name by each attempt and only those named in the manifest are read,
so a lost or repeated task leaves no wrong data. What reaches the driver is bounded by the
vocabulary (counts) and by the number of files (totals). Texts and ids go to Python and back a few
megabytes at a time, each different word of such a batch is looked up once, and the words that a worker
holds are freed by the passes behind the encoding.

Defined results: a null text is empty, an empty text is its end id alone; a null ``doc_id`` comes
first; rows with equal ids are ordered by a hash of their text; an empty table gives no file and an
empty result; other columns are not read.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import batched, query, rows, small_batches, table, to_batch
from larder.llm.files import opened_input, opened_output
from larder.llm.huffman import Code, code_lengths
from larder.llm.tokens import release, word_ids
from larder.session import new_path, stage

MAGIC = b"HUFT"
BLOCK_IDS = 1 << 18
END_ID = 1
VOCABULARY = 1 << 16
BATCH_BYTES = 4 << 20
HEAD = struct.Struct("<IQQQ")

STAGED = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary())])
COUNTS = pa.schema([("id", pa.int64()), ("n", pa.int64())])
MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
DECODED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def tokenised(docs: DataFrame, tokenizer: str, spaces: str) -> DataFrame:
    """doc_id, a tie-breaker and the ids as 16-bit integers, staged."""
    def run(batches):
        words, end = word_ids(tokenizer, spaces), END_ID.to_bytes(4, "little")

        def found():
            for batch in batches:
                for (doc_id, tie), ids in zip(rows([batch], "doc_id", "tie"), words.texts(batch["text"])):
                    yield doc_id, tie, np.frombuffer(ids + end, "<u4").astype("<u2").tobytes()
        return batched(found(), STAGED, limit=BATCH_BYTES)

    rows_in = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    with small_batches(docs.sparkSession):
        return stage(rows_in.mapInArrow(run, "doc_id long, tie long, ids binary"), "token-ids")


def id_counts(staged: DataFrame) -> np.ndarray:
    """How often each id occurs; at most ``VOCABULARY`` rows reach the driver."""
    def run(batches):
        release()
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2")
            total += np.bincount(ids, minlength=VOCABULARY)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], schema=COUNTS)

    summed = staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(VOCABULARY, np.int64)
    with small_batches(staged.sparkSession):
        for id_, n in summed.collect():
            counts[id_] = n
    return counts


def block_bytes(code: Code, docs: list[tuple], before: int) -> bytes:
    ids = np.concatenate([d for _, d in docs])
    stream, offsets = code.encode(ids)
    body = b"".join((
        HEAD.pack(len(docs), len(ids), before, len(stream)),
        bytes(doc_id is None for doc_id, _ in docs),
        np.array([doc_id or 0 for doc_id, _ in docs], "<i8").tobytes(),
        np.array([len(d) for _, d in docs], "<u8").tobytes(), offsets.tobytes(), stream))
    return len(body).to_bytes(4, "little") + body


def write_files(staged: DataFrame, lengths: np.ndarray, folder: str) -> DataFrame:
    """Write every range of documents to a file; returns the manifest, staged."""
    packed = zlib.compress(lengths.tobytes())

    def run(batches):
        release()
        part, code = TaskContext.get().partitionId(), Code(lengths)
        path, sink = f"{folder}/{part:06d}-{uuid.uuid4().hex}.huft", None
        held, held_ids, n_docs, n_ids = [], 0, 0, 0
        for doc_id, raw in rows(batches, "doc_id", "ids"):
            if sink is None:
                sink = opened_output(path)
                sink.write(MAGIC + len(packed).to_bytes(4, "little") + packed)
            ids = np.frombuffer(raw, "<u2")
            held.append((doc_id, ids))
            held_ids, n_docs = held_ids + len(ids), n_docs + 1
            if held_ids >= BLOCK_IDS:
                sink.write(block_bytes(code, held, n_ids))
                held, held_ids, n_ids = [], 0, n_ids + held_ids
        if held:
            sink.write(block_bytes(code, held, n_ids))
            n_ids += held_ids
        if sink is not None:
            sink.close()
            yield to_batch([(part, path, n_docs, n_ids)], MANIFEST)

    ordered = staged.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    with small_batches(staged.sparkSession):
        return stage(ordered.select("doc_id", "ids").mapInArrow(
            run, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def file_blocks(path: str) -> Iterator[tuple[list, np.ndarray, int, np.ndarray]]:
    """Per block of a file: doc ids, ids per document, ids before the block, all ids."""
    with opened_input(path) as source:
        if source.read(4) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        size = int.from_bytes(source.read(4), "little")
        code = Code(np.frombuffer(zlib.decompress(source.read(size)), np.uint8))
        while head := source.read(4):
            body = source.read(int.from_bytes(head, "little"))
            n_docs, n_ids, before, n_stream = HEAD.unpack_from(body)
            at = HEAD.size
            null = np.frombuffer(body, np.uint8, n_docs, at)
            doc_ids = np.frombuffer(body, "<i8", n_docs, at + n_docs)
            n_tokens = np.frombuffer(body, "<u8", n_docs, at + 9 * n_docs)
            n_marks = len(body) - n_stream - at - 17 * n_docs
            offsets = np.frombuffer(body, "<u8", n_marks // 8, at + 17 * n_docs)
            ids = code.decode(body[len(body) - n_stream:], n_ids, offsets)
            yield ([None if x else int(d) for x, d in zip(null, doc_ids)], n_tokens.astype(np.int64), before, ids)


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (unsigned 32-bit) per document."""
    spark = manifest.sparkSession
    files = sorted((r.part, r.path, r.n_ids) for r in manifest.collect())
    starts = accumulate((n for *_, n in files), initial=0)
    listed = [(path, start) for (_, path, _), start in zip(files, starts)]

    def run(batches):
        def docs():
            for path, start in rows(batches, "path", "start"):
                for doc_ids, n_tokens, before, ids in file_blocks(path):
                    ends = np.cumsum(n_tokens)
                    for doc_id, n, end in zip(doc_ids, n_tokens.tolist(), ends.tolist()):
                        yield doc_id, start + before + end - n, n, ids[end - n:end].astype("<u4").tobytes()
        release()
        return batched(docs(), DECODED, limit=BATCH_BYTES)

    paths = spark.createDataFrame(listed, "path string, start long")
    if listed:
        paths = paths.repartition(len(listed))
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def write_tokens(docs: DataFrame, tokenizer: str, spaces: str, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` and write them; the manifest of the files."""
    staged = tokenised(docs, tokenizer, spaces)
    lengths = code_lengths(id_counts(staged))
    return write_files(staged, lengths, folder or new_path(docs.sparkSession, "tokens"))


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "dropped")
    return read_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
