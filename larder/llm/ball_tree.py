"""Ranked lexical search by a ball tree over sparse document vectors.

A document is the vector of its terms' saturated frequencies, an item the vector of its terms' weights; both
are integers, and the score is their inner product. Documents are read in blocks of at most ``BLOCK_DOCS``
documents or ``BLOCK_TERMS`` distinct terms, and each block becomes a tree in the task that reads it: balls
are split at the median along the line between two far documents, ``FAN`` balls under a node, until a leaf
has ``LEAF`` documents.

* Bounds. A ball has a sparse centroid c, a radius r and, per term, how far its documents rise above the
  centroid, s. For an item q (no weight is negative) and any document d of the ball,
  q.d = q.c + q.(d - c) <= q.c + min(|q'| r, q.s), with q' the item's terms that occur in the ball. Radii are
  enlarged by what their own rounding can lose, and a bound by a billionth and one, which is far more than the
  rounding of its sums, so no bound is below a score.
* Search. Balls are opened best bound first; a ball whose bound is below the item's tenth score so far is
  pruned with all under it. Leaves are scored in 64-bit integers.
* Floors. The documents with a hash divisible by ``FLOOR_SHARE`` are searched first. The tenth score among them is
  a floor for the final tenth score, so every tree starts with it: whole trees are pruned below their root and
  a task returns few rows. It changes no result.

Items go to the tasks as files of about ``QUERY_TERMS`` terms, of which a worker holds one at a time; nothing
that grows with the input is broadcast. Counts of documents, terms and documents per term come from one pass
over all texts.

Defined results: a null, empty or term-less text is no document and a null or term-less item has no result;
rows that repeat an item id are searched one by one; rows that repeat a ``doc_id`` are ranked one by one, a
null ``doc_id`` behind equal scores; an empty table gives an empty result; other columns are not read.
"""

import heapq
import pickle
import uuid
from collections import Counter
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.base import query, rows, table, to_batch, utf8
from larder.llm.decontaminate import words_of
from larder.llm.files import opened_input, opened_output
from larder.session import new_path, stage

TOP = 10
BLOCK_DOCS, BLOCK_TERMS = 4096, 1 << 20
FAN, LEAF = 16, 16
FLOOR_SHARE = 32
QUERY_TERMS = 1 << 18
COUNTED_TERMS = 1 << 18
LINES = 16
MARGIN = 1e-9

COUNTS = pa.schema([("term", pa.binary()), ("df", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64())])
FOUND = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, docs, terms): documents per term, and in rows without a term documents and terms; partial sums."""
    def run(batches):
        df, n_docs, n_terms = Counter(), 0, 0

        def flushed():
            found = [(term, n, 0, 0) for term, n in df.items()]
            df.clear()
            for at in range(0, len(found), 1 << 16):
                yield to_batch(found[at:at + (1 << 16)], COUNTS)

        for (text,) in rows(batches, "bytes"):
            words = words_of(text)
            n_docs, n_terms = n_docs + bool(words), n_terms + len(words)
            df.update(set(words))
            if len(df) >= COUNTED_TERMS:
                yield from flushed()
        yield from flushed()
        yield to_batch([(None, 0, n_docs, n_terms)], COUNTS)

    return docs.select(utf8("text").alias("bytes")).mapInArrow(run, "term binary, df long, docs long, terms long")


def weighted_items(items: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """q, terms and weights (of a term's repeats together) of each item with a term that documents hold."""
    def run(batches):
        for batch in batches:
            found = [(q, term, n) for q, text in zip(*(c.to_pylist() for c in batch.columns))
                     for term, n in Counter(words_of(text)).items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found) if found else ([],) * 3, (pa.int64(), pa.binary(), pa.int64()))],
                names=["q", "term", "n"])

    terms = items.select("q", utf8("text").alias("bytes")).mapInArrow(run, "q long, term binary, n long")
    df = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1)))
    return (terms.join(df, "term").select("q", "term", (F.col("n") * weight).alias("weight"))
            .groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("terms")))


def write_items(weighted: DataFrame, floors: DataFrame | None) -> list[str]:
    """Files of about ``QUERY_TERMS`` terms, written by tasks; their paths."""
    spark, folder = weighted.sparkSession, new_path(weighted.sparkSession, "search-items")
    blocks = max(1, -(-(weighted.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS))
    read = weighted.withColumn("floor", F.lit(1)) if floors is None else weighted.join(floors, "q", "left")

    def run(batches):
        held = [(q, terms, floor or 1) for q, terms, floor in rows(batches, "q", "terms", "floor")]
        if held:
            path = f"{folder}/{uuid.uuid4().hex}"
            with opened_output(path) as sink:
                sink.write(pickle.dumps([(q, [t["term"] for t in terms], np.array([t["weight"] for t in terms], np.int64), floor)
                                         for q, terms, floor in held]))
            yield to_batch([(path,)], pa.schema([("path", pa.string())]))

    written = read.select("q", "terms", "floor").repartition(blocks, "q").mapInArrow(run, "path string")
    return sorted(r.path for r in stage(written, "search-item-paths").collect())


def read_items(path: str) -> list[tuple]:
    with opened_input(path) as source:
        return pickle.loads(source.read())


class Ball:
    """Documents ``first`` to ``end`` of a tree; an inner ball also holds what the bounds of its children need.

    Per term of the children: ``ptr`` into ``child``, ``centre`` and ``spread``.
    """
    __slots__ = ("first", "end", "children", "terms", "ptr", "child", "centre", "spread", "radius")

    def __init__(self, first: int, end: int, children: list["Ball"]):
        self.first, self.end, self.children = first, end, children


class BallTree:
    """A block of documents: term ids, impacts and bounds of each (CSR), and the tree over them."""

    def __init__(self, docs: list[tuple], vocabulary: dict[bytes, int], leaf: int = LEAF, fan: int = FAN):
        """``docs``: (doc_id, term ids, impacts); no document is without terms."""
        self.vocabulary, self.leaf, self.fan = vocabulary, leaf, fan
        sizes = np.array([len(ids) for _, ids, _ in docs], np.int64)
        ids, impacts = (np.concatenate([d[i] for d in docs]) for i in (1, 2))
        order = self._order(sizes, ids, impacts)
        starts = np.r_[0, np.cumsum(sizes)]
        taken = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order])
        self.doc_ids = [docs[i][0] for i in order]
        self.ids, self.impacts = ids[taken], impacts[taken]
        self.starts = np.r_[0, np.cumsum(sizes[order])]
        self.root = self._ball(0, len(docs))

    def _order(self, sizes, ids, impacts) -> list[int]:
        """Documents in an order whose runs are balls: split at the median along the line of two far documents."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        rng = np.random.default_rng(1)
        table_ = rng.standard_normal((LINES, 1 << 12))
        rare = impacts * np.log1p(len(sizes) / np.bincount(ids)[ids])
        points = np.stack([np.bincount(doc, rare * line[ids & 0xFFF], len(sizes)) for line in table_], axis=1)
        points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-30
        out, todo = [], [np.arange(len(sizes))]
        while todo:
            part = todo.pop()
            if len(part) <= self.leaf:
                out += part.tolist()
                continue
            near = points[part]
            a = near[np.argmax(((near - near.mean(0)) ** 2).sum(1))]
            b = near[np.argmax(((near - a) ** 2).sum(1))]
            part = part[np.argsort(near @ (b - a), kind="stable")]
            half = self._half(len(part))
            todo += [part[half:], part[:half]]
        return out

    def _half(self, n: int) -> int:
        """The left part of ``n`` documents: half of the leaves that they fill."""
        leaves = -(-n // self.leaf)
        return (leaves + 1) // 2 * self.leaf

    def _ball(self, first: int, end: int) -> Ball:
        if end - first <= self.leaf:
            return Ball(first, end, [])
        parts = [(first, end)]
        while len(parts) < self.fan and any(b - a > self.leaf for a, b in parts):
            parts = [p for a, b in parts for p in
                     ([(a, a + self._half(b - a)), (a + self._half(b - a), b)] if b - a > self.leaf else [(a, b)])]
        ball = Ball(first, end, [self._ball(a, b) for a, b in parts])
        self._measure(ball)
        return ball

    def _measure(self, ball: Ball) -> None:
        """Centroids, spreads and radii of a ball's children."""
        starts = self.starts[ball.first:ball.end + 1]
        ids, impacts = self.ids[starts[0]:starts[-1]], self.impacts[starts[0]:starts[-1]].astype(np.float64)
        n_docs = np.array([c.end - c.first for c in ball.children])
        child_of_doc = np.repeat(np.arange(len(n_docs)), n_docs)
        child = np.repeat(child_of_doc, np.diff(starts))
        order = np.lexsort((child, ids))
        key = np.stack([ids, child])[:, order]
        at = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        total, most = (f.reduceat(impacts[order], at) for f in (np.add, np.maximum))
        ball.child = key[1, at]
        ball.centre = total / n_docs[ball.child]
        ball.spread = np.maximum(most - ball.centre, 0)
        term_at = np.flatnonzero(np.r_[True, key[0, at][1:] != key[0, at][:-1]])
        ball.terms, ball.ptr = key[0, at][term_at], np.r_[term_at, len(at)]
        # |d - c|^2 = |d|^2 - 2 d.c + |c|^2
        per_entry = np.empty(len(ids))
        per_entry[order] = np.repeat(ball.centre, np.diff(np.r_[at, len(ids)]))
        offsets = starts[:-1] - starts[0]
        own = np.add.reduceat(impacts * impacts, offsets)
        both = np.add.reduceat(impacts * per_entry, offsets)
        of_centre = np.bincount(ball.child, ball.centre ** 2, len(n_docs))[child_of_doc]
        squared = np.maximum(own - 2 * both + of_centre, 0) + MARGIN * (own + of_centre)
        ball.radius = np.sqrt(np.maximum.reduceat(squared, np.r_[0, np.cumsum(n_docs)[:-1]]))

    def bounds(self, ball: Ball, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per child: no document in it scores more; 0 where it holds no term of the item (``ids`` are sorted)."""
        at = np.minimum(np.searchsorted(ball.terms, ids), len(ball.terms) - 1)
        held = ball.terms[at] == ids
        first, n = ball.ptr[at[held]], np.diff(ball.ptr)[at[held]]
        entry = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        child, weight, k = ball.child[entry], np.repeat(weights[held], n).astype(np.float64), len(ball.children)
        centre = np.bincount(child, weight * ball.centre[entry], k)
        above = np.minimum(np.sqrt(np.bincount(child, weight * weight, k)) * ball.radius,
                           np.bincount(child, weight * ball.spread[entry], k))
        return np.where(centre + above > 0, (centre + above) * (1 + MARGIN) + 1, 0)

    def scores(self, ball: Ball, dense: np.ndarray) -> np.ndarray:
        """The exact scores of a leaf's documents."""
        starts = self.starts[ball.first:ball.end + 1]
        part = slice(starts[0], starts[-1])
        return np.add.reduceat(dense[self.ids[part]] * self.impacts[part], starts[:-1] - starts[0])

    def search(self, terms: list[bytes], weights: np.ndarray, floor: int = 1, top: int = TOP,
               dense: np.ndarray | None = None) -> tuple[list[tuple], int]:
        """(score, doc_id) of the ``top`` best documents with at least ``floor``, and how many leaves were scored."""
        found = sorted((i, w) for i, w in zip(map(self.vocabulary.get, terms), weights.tolist()) if i is not None)
        if not found:
            return [], 0
        ids, weights = np.array(found, np.int64).T
        if dense is None:
            dense = np.zeros(len(self.vocabulary), np.int64)
        dense[ids] = weights
        best: list[tuple] = []  # (-score, without id, doc_id), sorted
        n_leaves, number = 0, count()
        heap = [(-np.inf, 0, self.root)]
        while heap:
            bound, _, ball = heapq.heappop(heap)
            if -bound < floor:
                break
            if ball.children:
                for limit, child in zip(self.bounds(ball, ids, weights).tolist(), ball.children):
                    if limit >= floor:
                        heapq.heappush(heap, (-limit, next(number), child))
                continue
            n_leaves += 1
            scores = self.scores(ball, dense)
            for i in np.flatnonzero(scores >= floor).tolist():
                doc_id = self.doc_ids[ball.first + i]
                best.append((-int(scores[i]), doc_id is None, doc_id or 0))
            best = sorted(best)[:top]
            if len(best) == top:
                floor = max(floor, -best[-1][0])
        dense[ids] = 0
        return [(-score, None if without else doc_id) for score, without, doc_id in best], n_leaves


def trees(docs, n_docs: int, n_terms: int, block_docs: int = BLOCK_DOCS):
    """Ball trees over a stream of (doc_id, text)."""
    held, vocabulary, size = [], {}, 0
    for doc_id, text in docs:
        words = words_of(text)
        if not words:
            continue
        tf = Counter(words)
        m = 100 - 75 + 75 * len(words) * n_docs // n_terms
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tf), np.int64, len(tf))
        times = np.fromiter(tf.values(), np.int64, len(tf))
        held.append((doc_id, ids, 1_000_000_000 * times // (1000 * times + 8 * m)))
        size += len(ids)
        if len(held) >= block_docs or size >= BLOCK_TERMS:
            yield BallTree(held, vocabulary)
            held, vocabulary, size = [], {}, 0
    if held:
        yield BallTree(held, vocabulary)


def searched(docs: DataFrame, paths: list[str], n_docs: int, n_terms: int, top: int, block_docs: int) -> DataFrame:
    """(q, doc_id, score): the best documents of each tree for each item."""
    def run(batches):
        for tree in trees(rows(batches, "doc_id", "bytes"), n_docs, n_terms, block_docs):
            dense = np.zeros(len(tree.vocabulary), np.int64)
            for path in paths:
                found = [(q, doc_id, score) for q, terms, weights, floor in read_items(path)
                         for score, doc_id in tree.search(terms, weights, floor, top, dense)[0]]
                if found:
                    yield to_batch(found, FOUND)

    return docs.select("doc_id", utf8("text").alias("bytes")).mapInArrow(run, "q long, doc_id long, score long")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, floor_share: int = FLOOR_SHARE,
           block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each item (item_id, text)."""
    docs = docs.select("doc_id", "text")
    counts = stage(term_counts(docs), "term-counts")
    n_docs, n_terms = counts.agg(F.sum("docs"), F.sum("terms")).first()
    items = stage(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "search-items")
    if not n_docs:
        n_docs, n_terms = 0, 1
    weighted = stage(weighted_items(items, counts, n_docs), "weighted-items")

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(floor_share)) == 0)
    first = ranked(searched(some, write_items(weighted, None), n_docs, n_terms, top, block_docs), top)
    floors = first.where(F.col("rank") == top).select("q", F.col("score").alias("floor"))
    paths = write_items(weighted, stage(floors, "search-floors"))
    best = ranked(searched(docs, paths, n_docs, n_terms, top, block_docs), top)
    return items.select("q", "item_id").join(best, "q").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


@query("op12_lexical_search", oracle=r"""
    WITH low AS (
        SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
        UNION ALL
        SELECT 'q', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
    words AS (
        SELECT kind, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
    tf AS (SELECT kind, id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT id, sum(tf)::BIGINT AS n FROM tf WHERE kind = 'd' GROUP BY id),
    totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
    m AS (SELECT id, 25 + (75 * n * docs) // terms AS m FROM sizes, totals),
    df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
           FROM tf, totals WHERE kind = 'd' GROUP BY term, docs),
    scored AS (
        SELECT q.id AS item_id, d.id AS doc_id,
               sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m)))::BIGINT AS score
        FROM tf q JOIN df USING (term) JOIN tf d ON d.term = q.term AND d.kind = 'd' JOIN m ON m.id = d.id
        WHERE q.kind = 'q' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
          FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op12_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
