"""Cost-balanced packing of token ids into sequences of at most ``limit`` tokens.

A document of n tokens gives ``n // limit`` full sequences; what is left over is packed with other
leftovers of its scan partition, about ``GROUP_TOKENS`` at a time, so nothing is shuffled and a task
holds one group. A piece costs ``LINEAR * n + QUADRATIC * n * n`` (projections and attention). In
descending length, each leftover goes to the cheapest sequence with room for it; one that fits
nowhere is cut over the cheapest sequences with any room. A group of T tokens gets ``T // limit``
sequences and, for the rest, sequences whose lengths are the powers of two of ``T % limit``, which
need no padding either.

Defined results: a null text is empty, an empty text is its end id alone; a null ``doc_id`` stays
null; rows that repeat an id are packed one by one; an empty table gives an empty result; other
columns are not read. ``sequence_id`` is the scan partition times 2**32 plus a counter.
"""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import batched, query, rows, table
from larder.llm.tokens import word_ids

LIMIT = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_TOKENS = 1 << 20
END_ID = 1

PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
                  + [("ids", pa.binary())])


def capacities(total: int, limit: int) -> np.ndarray:
    """Sequence lengths that hold ``total`` tokens exactly: full ones, then powers of two."""
    rest = total % limit
    return np.array([limit] * (total // limit) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1],
                    dtype=np.int64)


def assign(lengths: list[int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """(index, start, length, sequence, offset) of every piece."""
    size = capacities(sum(lengths), limit)
    room, cost, out = size.copy(), np.zeros(len(size)), []

    def put(i, start, n, s):
        out.append((i, start, n, s, int(size[s] - room[s])))
        room[s] -= n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[i]
        while left:
            fits = np.flatnonzero(room >= left)
            open_ = fits if len(fits) else np.flatnonzero(room)
            s = int(open_[np.argmin(cost[open_])])
            n = min(left, int(room[s]))
            put(i, start, n, s)
            start, left = start + n, left - n
    return out


def packed(docs, limit: int, group_tokens: int, first: int):
    """Pieces of a stream of (doc_id, ids as bytes)."""
    held, held_tokens, sequence = [], 0, first

    def flush():
        nonlocal held, held_tokens, sequence
        found = assign([len(ids) // 4 for _, ids, _ in held], limit)
        for i, start, n, s, offset in found:
            doc_id, ids, base = held[i]
            yield (doc_id, base + start, n, base + len(ids) // 4, sequence + s, offset,
                   ids[4 * start:4 * (start + n)])
        sequence += max((s for *_, s, _ in found), default=-1) + 1
        held, held_tokens = [], 0

    for doc_id, ids in docs:
        n = len(ids) // 4
        whole = n - n % limit
        for start in range(0, whole, limit):
            yield doc_id, start, limit, n, sequence, 0, ids[4 * start:4 * (start + limit)]
            sequence += 1
        if n > whole:
            held.append((doc_id, ids[4 * whole:], whole))
            held_tokens += n - whole
        if held_tokens >= group_tokens:
            yield from flush()
    yield from flush()


def pack(docs: DataFrame, tokenizer: str, spaces: str = "leading", limit: int = LIMIT,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        words = word_ids(tokenizer, spaces)
        end = END_ID.to_bytes(4, "little")
        encoded = ((doc_id, words.text(text or "") + end) for doc_id, text in rows(batches, "doc_id", "text"))
        first = TaskContext.get().partitionId() << 32
        return batched(packed(encoded, limit, group_tokens, first), ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def piece_rows(docs: DataFrame) -> DataFrame:
    """The pieces under the byte BPE, with a checksum in place of the ids."""
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return piece_rows(table(spark, sf_dir, "documents"))
