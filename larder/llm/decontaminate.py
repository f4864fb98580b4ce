"""Benchmark decontamination with a generalised suffix automaton.

Items are normalised to lower-case words; an automaton holds every word sequence of the items. The
words of a document are streamed through it, which yields the longest match ending at each word. A
match of at least ``window`` words, or of a whole shorter item, hits the words it covers. A document
whose hit words exceed the coverage limit is contaminated; spans can be removed instead.

Items come in blocks of about ``BLOCK_WORDS`` words. One automaton per block is built in a task and
written to the shared folder; a worker holds one block at a time and unites the hits of all blocks,
so a larger benchmark costs time, not memory. Nothing is broadcast.

Defined results: null or empty texts have no words and no hits; an item without words has no window;
items without an id hit words but are not listed; an item id that occurs twice is listed once; equal
items are all listed; rows that repeat a ``doc_id`` are judged one by one; an empty benchmark hits
nothing; an empty document table gives an empty result; other columns pass through unread.
"""

import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.automaton import SuffixAutomaton
from larder.llm.base import free_name, query, rows, table, to_batch, utf8
from larder.llm.files import opened_input, opened_output
from larder.session import new_path, stage

WINDOW = 13
COVERAGE = 20          # contaminated when COVERAGE * hit words >= words
BLOCK_WORDS = 1 << 20
BATCH_BYTES = 32 << 20   # text that a task matches with one block before it loads the next

# Everything but digits, lower-case letters (after lower-casing) and bytes of non-ASCII characters.
SEPARATORS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(SEPARATORS).split()


class Matcher:
    """One block of items, ready to be matched."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.vocabulary, self.automaton = window, {}, SuffixAutomaton()
        coded = [(id_, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for id_, words in items]
        for _, words in coded:
            self.automaton.add(words)
        link, length = self.automaton.link, self.automaton.length
        # The items of a window or short item are kept at its state; from a state the windows that
        # end there are found by following the links, `ends` naming the next one to look at.
        self.items: dict[int, set] = {}
        self.short: dict[int, int] = {}
        for id_, words in coded:
            states, _ = self.automaton.walk(words)
            if len(words) >= window:
                for state in states[window - 1:].tolist():
                    self.items.setdefault(self._holder(state, window), set()).add(id_)
            elif words:
                state = self._holder(int(states[-1]), len(words))
                self.items.setdefault(state, set()).add(id_)
                self.short[state] = len(words)
        order = sorted(range(len(link)), key=length.__getitem__)
        self.ends = [0] * len(link)
        # How long a match in a state must be to hold any window.
        self.least = np.full(len(link), np.iinfo(np.int32).max, np.int32)
        for state in order[1:]:
            parent = link[state]
            self.ends[state] = parent if parent in self.items else self.ends[parent]
            if self.ends[state]:
                self.least[state] = 1
            elif state in self.items:
                self.least[state] = self.short.get(state, window)

    def _holder(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a sequence that ends in ``state``."""
        link, length = self.automaton.link, self.automaton.length
        while length[link[state]] >= n:
            state = link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items with a window among them."""
        hit, found = np.zeros(len(words), bool), set()
        coded = list(map(self.vocabulary.get, words))
        states, lengths = self.automaton.walk(coded)
        for i in np.flatnonzero(lengths >= self.least[states]).tolist():
            state, size = int(states[i]), int(lengths[i])
            while state:
                if state in self.items:
                    n = self.short.get(state, self.window)
                    if size >= n:
                        hit[i + 1 - n:i + 1] = True
                        found |= self.items[state]
                state = self.ends[state]
                size = self.automaton.length[state]
        return hit, found


def build_matchers(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """One file per block of items, written by tasks; the paths."""
    spark = benchmark.sparkSession
    chars = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // (2 * block_words)))  # a word and its separator take two characters at least
    folder = new_path(spark, "benchmark-blocks")

    def build(batches):
        held = {}
        for block, id_, text in rows(batches, "block", "item_id", "bytes"):
            held.setdefault(block, []).append((id_, words_of(text)))
        for block, items in held.items():
            path = f"{folder}/{block}-{uuid.uuid4().hex}"
            with opened_output(path) as sink:
                sink.write(pickle.dumps(Matcher(items, window)))
            yield to_batch([(path,)], pa.schema([("path", pa.string())]))

    dealt = benchmark.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"),
                             F.col("item_id").cast("string"), utf8("text").alias("bytes"))
    written = dealt.repartition(blocks, "block").mapInArrow(build, "path string")
    return sorted(r.path for r in stage(written, "benchmark-paths").collect())


_LOADED: dict[str, Matcher] = {}


def loaded(path: str) -> Matcher:
    """The matcher of a block; a worker process keeps the last one only."""
    if path not in _LOADED:
        _LOADED.clear()
        with opened_input(path) as source:
            _LOADED[path] = pickle.loads(source.read())
    return _LOADED[path]


def spans_of(hit: np.ndarray) -> list[dict]:
    """Runs of hit words as (first, end)."""
    edges = np.flatnonzero(np.diff(hit, prepend=False, append=False)).tolist()
    return [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]


HITS = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                  ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                  ("contaminated", pa.bool_())])
MATCH = ("struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<first: int, end: int>>, "
         "contaminated: boolean>")


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
            block_words: int = BLOCK_WORDS, into: str = "match", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, items, spans (of words), contaminated.

    A task holds batches of about ``batch_bytes`` of text while it goes through the blocks.
    """
    paths = build_matchers(benchmark, window, block_words)
    at = docs.columns.index("text")

    def judged(texts):
        texts = [words_of((t or "").encode()) for t in texts]
        hits, items = [np.zeros(len(t), bool) for t in texts], [set() for _ in texts]
        for path in paths:
            matcher = loaded(path)
            for i, words in enumerate(texts):
                hit, found = matcher.match(words)
                hits[i] |= hit
                items[i] |= found
        counts = [(len(t), int(h.sum())) for t, h in zip(texts, hits)]
        columns = [[n for n, _ in counts], [n for _, n in counts],
                   [sorted(x for x in found if x is not None) for found in items], [spans_of(h) for h in hits],
                   [n_hit > 0 and coverage * n_hit >= n for n, n_hit in counts]]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, HITS)], fields=list(HITS))

    def run(batches):
        for held in gathered(batches, at, batch_bytes):
            found = judged([t for batch in held for t in batch.column(at).to_pylist()])
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns, found[:len(batch)]], names=[*batch.schema.names, into])
                found = found[len(batch):]

    schema = docs.select("*", F.lit(None).cast(MATCH).alias(into)).schema
    return docs.mapInArrow(run, schema)


def gathered(batches, at: int, limit: int):
    """Runs of batches whose column ``at`` holds about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose hit words stay under the coverage limit, unchanged."""
    into = free_name("match", docs)
    return matched(docs, benchmark, into=into).where(~F.col(into)["contaminated"]).drop(into)


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(docs: DataFrame, benchmark: DataFrame, longest: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """``docs`` with the benchmark cut out of ``text``; documents over the coverage limit are not returned.

    A span of hit words goes when it has at least ``longest`` words: from its first word up to the word after
    it, or to the end of the text. What is left is unchanged; a null text stays null.
    """
    into, at = free_name("match", docs), docs.columns.index("text")
    kept = matched(docs, benchmark, coverage=coverage, into=into).where(~F.col(into)["contaminated"])

    def cut(text, spans):
        spans = [s for s in spans if s["end"] - s["first"] >= longest]
        if not spans:
            return text
        raw, out, done = text.encode(), [], 0
        starts = [m.start() for m in WORD.finditer(raw)]
        starts.append(len(raw))
        for s in spans:
            out.append(raw[done:starts[s["first"]]])
            done = starts[s["end"]]
        return b"".join([*out, raw[done:]]).decode()

    def run(batches):
        for batch in batches:
            texts = map(cut, batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).field("spans").to_pylist())
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(list(texts), batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return kept.mapInArrow(run, docs.schema)


@query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    match = matched(docs, table(spark, sf_dir, "benchmark"))
    return match.select(
        "doc_id", "match.n_words", "match.n_hit", F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ","), 256).alias("items_sha256"), "match.contaminated")
