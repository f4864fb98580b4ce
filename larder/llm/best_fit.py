"""Best-fit packing with matching of large items.

A document of more than ``capacity`` tokens is cut into full pieces, the first one being what is left over.
Pieces above a third of the capacity are large: two of them fit in a sequence at most, so they are paired by
greedy matching, the longest with the longest partner that fits, which leaves the fewest sequences with large
pieces. The smaller pieces follow in descending length, each into the sequence with the smallest gap that
holds it; a new sequence is opened only where no gap does.

The packing is one plan for all documents, though no task sees them all: only lengths matter, so the driver
plans on how often each length occurs (at most ``capacity`` numbers). Sequences that are filled alike are one
entry of the plan, and an entry names the pieces by their rank among pieces of that length. A piece gets its rank from
its place in its scan partition and the counts of the partitions before, and looks up its sequence in the
plan. Neither a length that a third of all pieces have nor a long document meets in one task.

Texts are encoded a batch of a few megabytes at a time, and each different word of a batch is looked up once.

Bounds: a plan has an entry per length and group of sequences that it is added to; there are at most
``capacity`` lengths, and each adds at most two groups, so it has fewer than 2 * capacity ** 2 entries, and a few thousand
in practice. It is broadcast.

Defined results: a null text is empty, an empty text is its end id alone; a null ``doc_id`` stays null; rows
that repeat an id are packed one by one; an empty table gives an empty result; other columns are not read.
"""

from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.base import batched, query, small_batches, table
from larder.llm.tokens import word_ids
from larder.session import stage

CAPACITY = 1024
END_ID = 2
BATCH_BYTES = 4 << 20
ROW_GROUP = 16 << 20  # of the staged pieces

PIECES = "doc_id long, piece int, start long, length long, part int, nth long, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def matched(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """(longer, partner or 0, sequences) for all large lengths, by greedy matching."""
    left = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    lengths, out = sorted(left), []
    while lengths:
        longer = lengths.pop()
        if not (left_over := left.pop(longer)):
            continue
        while left_over:
            if left_over > 1 and 2 * longer <= capacity:  # all others are shorter
                out.append((longer, longer, left_over // 2))
                left_over %= 2
                continue
            at = bisect_left(lengths, capacity - longer + 1) - 1
            if at < 0:
                out.append((longer, 0, left_over))
                break
            partner = lengths[at]
            n = min(left_over, left[partner])
            out.append((longer, partner, n))
            left_over -= n
            left[partner] -= n
            if not left[partner]:
                del left[partner], lengths[at]
    return out


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan for ``counts`` pieces of each length, as rows (length, first rank, first sequence, each, offset).

    From the first rank on, ``each`` consecutive pieces of a length go to one sequence, one after the other
    from ``offset``; the next ``each`` go to the sequence after it.
    """
    ranks, entries = dict.fromkeys(counts, 0), []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), sorted
    opened = 0

    def put(length, sequence, sequences, each, offset):
        entries.append((length, ranks[length], sequence, each, offset))
        ranks[length] += sequences * each

    def leave(gap, sequence, sequences):
        if gap and sequences:
            insort(gaps, (gap, sequence, sequences))

    for longer, partner, n in matched(counts, capacity):
        put(longer, opened, n, 1, 0)
        if partner:
            put(partner, opened, n, 1, longer)
        leave(capacity - longer - partner, opened, n)
        opened += n
    for length in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, (length,))
            if at < len(gaps):
                gap, sequence, available = gaps.pop(at)
            else:
                gap, sequence, available = capacity, opened, -(-left // (capacity // length))
                opened += available
            each = min(gap // length, left)
            n = min(available, left // each)
            put(length, sequence, n, each, capacity - gap)
            left -= n * each
            leave(gap - each * length, sequence, n)
            leave(gap, sequence + n, available - n)
    return np.array(sorted(entries), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, spaces: str = "leading", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their ids (unsigned 32-bit), staged.

    ``part`` and ``nth`` are a piece's scan partition and its place among the partition's pieces of that length.
    """
    def run(batches):
        words, end = word_ids(tokenizer, spaces), END_ID.to_bytes(4, "little")
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)

        def found():
            for batch in batches:
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.texts(batch["text"])):
                    ids += end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        yield doc_id, piece, start, length, part, seen[length], ids[4 * start:4 * (start + length)]
                        seen[length] += 1
        return batched(found(), ARROW, limit=BATCH_BYTES)

    with small_batches(docs.sparkSession, n_bytes=BATCH_BYTES):
        return stage(docs.select("doc_id", "text").mapInArrow(run, PIECES), "packing-pieces", ROW_GROUP)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, part, nth and any other columns) with sequence_id and offset in place of part and nth."""
    per_part = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(planned(counts, capacity))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        entries = plan.value
        at = np.searchsorted(entries[:, 0] << 44 | entries[:, 1], length << 44 | rank, "right") - 1
        _, first, sequence, each, offset = entries[at].T
        nth = rank - first
        return pa.StructArray.from_arrays(
            [pa.array(sequence + nth // each), pa.array(offset + nth % each * length)], names=["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["part", "length"])
    others = [c for c in pieces.columns if c not in ("part", "nth")]
    found = ranked.select(*others, place("length", F.col("before") + F.col("nth")).alias("place"))
    return found.select(*others, "place.sequence_id", "place.offset")


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence; a group is bounded by the capacity."""
    members = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.reduce(members, F.lit(b""), lambda ids, m: F.concat(ids, m["ids"]))
    return placed_pieces.groupBy("sequence_id").agg(joined.alias("ids"))


@query("op13_best_fit")
def op13_best_fit(spark, sf_dir):
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    out = placed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
